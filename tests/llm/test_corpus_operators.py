"""Corpus operators that look across rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from tracewell.llm import minhash, mixing, url_rules

DOCS = "doc_id long, text string, kept string"


# --- near duplicates


def brute_components(rows, percent=85):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def edited(base, step):
    return " ".join(f"edit{step}" if k % 97 == step % 97 else w for k, w in enumerate(base))


def test_near_duplicates_match_all_pairs(spark, small):
    base = [f"word{k}" for k in range(200)]
    rows = [(i, edited(base, i * 7)) for i in range(40)]  # many near copies of one text
    rows += [(100 + i, "same text in all of these rows here") for i in range(30)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "Two\tWORDS"), (205, "two words more")]
    rows += [(300 + i, " ".join(f"solo{i}x{k}" for k in range(50)) + " a b c d e f g h") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert out == brute_components(rows)


def test_repeated_and_missing_ids(spark):
    """An id that stands in rows of different texts has all their links, in any order of rows."""
    a, b = ([f"{x}{k}" for k in range(120)] for x in "ab")
    rows = [(10, edited(a, 1)), (10, edited(b, 1)), (20, edited(a, 2)), (30, edited(b, 2)), (40, "other words"), (40, "other words"), (None, edited(a, 2)), (None, "alone here"), (None, "alone here"), (None, None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in order], "doc_id long, text string, row int, same string")
        out = sorted(((r["doc_id"] or -1), r["n_shingles"], r["component_id"] or -1, r["kept"]) for r in minhash.near_duplicates(docs).collect())
        n = {w: len({tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for w, t in (("a", rows[0][1]), ("b", rows[1][1]), ("c", rows[2][1]), ("d", rows[3][1]))}
        want = [(10, n["a"], 10, True), (10, n["b"], 10, True), (20, n["c"], 10, False), (30, n["d"], 10, False), (40, 1, 40, True), (40, 1, 40, True)]
        want += [(-1, n["c"], 10, False), (-1, 1, -1, True), (-1, 1, -1, True), (-1, 0, -1, True)]
        assert out == sorted(want)


def test_dedup_stage_keeps_one_row_of_each_class(spark, small):
    import corpus_pipeline

    a = [f"a{k}" for k in range(120)]
    rows = [(10, edited(a, 1)), (20, edited(a, 2)), (40, "other words"), (40, "other words"), (None, edited(a, 2)), (None, "alone here"), (None, "alone here"), (50, None), (51, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, row int")
    out = corpus_pipeline.dedup_stage(spark, docs, small)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"] or -1), r["text"] or "") for r in out.collect()) == sorted([(10, edited(a, 1)), (40, "other words"), (-1, "alone here"), (50, ""), (51, "")])


def test_heavy_keys_are_dealt_over_tasks(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    table = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    counts = rows.groupBy("k").agg(F.count("*").alias("many"))
    heavy = minhash.heavy_keys(counts, "k", "many", 5000)
    assert [r[0] for r in heavy.collect()] == [0]
    for how in ("inner", "left", "left_semi"):
        got = minhash.spread_join(rows, table, "k", heavy, "id", how)
        assert sorted(map(tuple, got.select("id", "k").collect())) == sorted(map(tuple, rows.join(table, "k", how).select("id", "k").collect()))


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_sketch_fills_and_agrees_by_similarity():
    assert all((minhash.sketch(minhash.shingle_set([b"w%d" % i for i in range(n)])) != minhash._FULL).all() for n in (1, 2, 5, 9, 40, 3000))
    a = minhash.shingle_set([b"w%d" % i for i in range(4000)])
    b = minhash.shingle_set([b"w%d" % i for i in range(400, 4400)])
    agree = (minhash.sketch(a) == minhash.sketch(b)).mean()
    assert abs(agree - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.12


def test_components_of_chains_and_hubs(spark):
    chain = [(i + 1, i) for i in range(100, 140)]
    hub = [(k, 5) for k in range(6, 90)]
    out = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(chain + hub + hub[:3], "a long, b long")).collect()}
    assert all(out[i] == 100 for i in range(101, 141)) and all(out[k] == 5 for k in range(6, 90)) and not out.keys() & {5, 100}


# --- mixing


def test_rates_meet_targets(spark):
    soft = spark.range(3000).select(
        (F.col("id") % 7 + 1).alias("tokens"),
        F.when(F.col("id") % 3 == 0, 0.9).otherwise(0.05).alias("p_clean"),
        F.when(F.col("id") % 3 == 1, 0.9).otherwise(0.05).alias("p_poor"),
        F.when(F.col("id") % 3 == 2, 0.9).otherwise(0.05).alias("p_toxic"),
    )
    moves, log = mixing.fit_rates(soft, {"clean": 0.5, "poor": 0.3, "toxic": 0.2})
    rated = mixing.with_rates(soft, moves)
    total = soft.agg(F.sum("tokens")).first()[0]
    got = rated.agg(*[(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{d}")) / total).alias(d) for d in mixing.DOMAINS]).first()
    assert (got["clean"], got["poor"], got["toxic"]) == (pytest.approx(0.5, abs=0.01), pytest.approx(0.3, abs=0.01), pytest.approx(0.2, abs=0.01))
    assert rated.where("rate < 0").count() == 0 and abs(log[-1]["clean"]) < abs(log[0]["clean"])


def test_rates_of_rare_domains_meet_targets(spark):
    soft = spark.range(20_000).select(
        F.lit(3).alias("tokens"),
        F.when(F.col("id") % 1000 > 1, 1.0).otherwise(0.0).alias("p_clean"),
        F.when(F.col("id") % 1000 == 0, 1.0).otherwise(0.0).alias("p_poor"),
        F.when(F.col("id") % 1000 == 1, 1.0).otherwise(0.0).alias("p_toxic"),
    )
    pulls, log = mixing.fit_rates(soft)
    rates = {d: mixing.with_rates(soft, pulls).where(f"p_{d} = 1").agg(F.avg("rate")).first()[0] for d in mixing.DOMAINS}
    assert rates["toxic"] < 0.01 and rates["poor"] == pytest.approx(100, rel=0.01) and rates["clean"] == pytest.approx(0.9 / 0.998, rel=0.01)
    assert not mixing.missed(log)


def test_targets_that_no_rates_meet_are_named(spark):
    soft = spark.range(100).select(F.lit(1).alias("tokens"), F.lit(0.5).alias("p_clean"), F.lit(0.5).alias("p_poor"), F.lit(0.0).alias("p_toxic"))
    pulls, log = mixing.fit_rates(soft)
    assert mixing.missed(log) == {"clean": pytest.approx(-0.4, abs=0.01), "poor": pytest.approx(0.4, abs=0.01)}
    with pytest.warns(UserWarning, match="poor"):
        out = mixing.with_misses(mixing.with_rates(soft, pulls), log).first()
    assert "poor +0.4" in out["targets_missed"] and out["rate"] == pytest.approx(1, abs=0.01)


def test_classifier_finds_domains(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    out = mixing.mix_sources(docs, labels).join(labels.withColumn("domain", mixing.domain_of_labels()), "doc_id")
    best = F.when(F.expr("p_clean >= p_poor AND p_clean >= p_toxic"), "clean").when(F.expr("p_poor >= p_toxic"), "poor").otherwise("toxic")
    assert out.where(best == F.col("domain")).count() / out.count() > 0.85


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (1, "", 5.0), (2, "a b", 5.0), (None, "a b", 5.0)], "doc_id long, text string, rate double")
    labels = spark.createDataFrame([(2, 1, None), (3, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.mix_sources(docs, labels).collect()
    assert len(rows) == 4 and sorted(r["tokens"] for r in rows) == [0, 0, 2, 2]
    assert mixing.mix_sources(docs.where("false"), labels.where("false")).count() == 0


# --- URL rules


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fits)[2], max(fits)[3]) if fits else (None, "allow")))


URLS = [
    "http://example.com/en/x?q=1",
    "https://WWW.Example.com/en/",
    "https://a.www.example.com/en/y#z",
    "https://example.com/fr",
    "http://notexample.com/en/",
    "http://x.net/es/1",
    "http://x.net/esp",
    "http://net/fr/",
    "http://com",
    "http://com?x",
    "no scheme",
    "://",
    "http://a..com/b",
    "ftp://é.com/ü",
    "",
    None,
]


@pytest.mark.parametrize("parts", [1, 3])
def test_url_rules(spark, parts):
    more = [*url_rules.RULES, ("block", "example.com", ""), ("allow", "b.example.com", "/e"), ("block", "a..com", "/")]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    out = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge_urls(pages, spark.createDataFrame(more, "verdict string, host string, path string"), parts=parts).collect()}
    assert out == {i: plain_verdict(u, more) for i, u in enumerate(URLS * 2)}
    assert url_rules.judge_urls(pages.where("false"), spark.createDataFrame(more, "verdict string, host string, path string")).count() == 0


# --- the pipeline


def test_pipeline_keeps_columns_and_acts(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        assert docs.count() > n * 0.5
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert out.count() == docs.count() and out.where("rate IS NULL OR rate < 0").count() == 0

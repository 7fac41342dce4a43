"""URL rules by a sort-merge range join.

A host is written label by label from the right (``com/example/www/``), so that
a rule's host and all its subdomains are one interval of that order. URLs are
dealt out in ranges of the order (host, path, id), which splits a busy host; a
rule goes to every range that its interval meets. Within a range rules and URLs
are swept in order with a stack of the nested rules that are open at a host;
of those whose path the URL's path starts with, the longest decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query: fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty without ``://`` or if null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """``a.b.c`` as ``c/b/a/``: no host holds a slash, so an interval of keys is a subtree."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/")))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, key and rules first; the stack starts anew with each range."""
    current, stack = None, []  # of (key, {path: (rule, verdict)}, lengths of the paths)
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("part", "key", "is_url", "path", "rule", "verdict")}
        keep, rules, verdicts = [], [], []
        for i in range(batch.num_rows):
            part, key = cols["part"][i], cols["key"][i]
            if part != current:
                current, stack = part, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not cols["is_url"][i]:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}, set()))
                path = cols["path"][i]
                stack[-1][1].setdefault(path, (cols["rule"][i], cols["verdict"][i]))
                stack[-1][2].add(len(path))
                continue
            path, best = cols["path"][i], None
            for host, by_path, lengths in stack:
                for n in lengths:
                    if n <= len(path) and (hit := by_path.get(path[:n])) is not None:
                        rank = (len(hit[0]), len(host))
                        if best is None or rank > best[0]:
                            best = (rank, hit)
            keep.append(i)
            rules.append(best[1][0] if best else None)
            verdicts.append(best[1][1] if best else None)
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [rows.column("id"), rows.column("host"), rows.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", parts: int | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages``.

    ``rules`` has ``verdict``, ``host`` and ``path``; a rule fits its host and all
    its subdomains where the URL's path starts with its path, and the longest
    (host and path together) wins, then the one with the longer host. Of two
    equal rules the smaller verdict holds. A URL that no rule fits has a null
    rule and the verdict ``default``; so have null URLs. Rules with a null are
    dropped. Repeated rows of ``pages`` are judged each; other columns ignored.
    """
    spark = pages.sparkSession
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("key", reversed_host(F.col("host")))
    urls = urls.repartitionByRange(n, "key", "path", "id").withColumn("part", F.spark_partition_id())
    urls = materialise(urls)

    # One interval for each range, so as many rows as partitions.
    ends = urls.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("part").collect()
    ranges = F.array(*[F.struct(F.lit(r["part"]).alias("part"), F.lit(r["lo"]).alias("lo"), F.lit(r["hi"]).alias("hi")) for r in ends])
    clean = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna()
    clean = clean.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    clean = clean.withColumn("key", reversed_host(F.col("host")))
    if ends:
        met = F.filter(ranges, lambda r: (F.col("key") <= r["hi"]) & (F.substring(r["lo"], 1, F.length("key")) <= F.col("key")))
        dealt = clean.withColumn("part", F.explode(F.transform(met, lambda r: r["part"])))
    else:
        dealt = clean.where("false").withColumn("part", F.lit(0))
    both = urls.select("part", "key", F.lit(True).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).unionByName(
        dealt.select("part", "key", F.lit(False).alias("is_url"), F.lit(None).cast("long").alias("id"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    )
    both = both.repartitionByRange(n, "part").sortWithinPartitions("part", "key", "is_url", "path")
    out = both.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op10_url_rules(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all ``pages``; nulls, empty and repeated rows as in ``judge_urls``."""
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP10_SQL = """
WITH rules(verdict, host, path) AS (VALUES
    ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (
    SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest),
best AS (
    SELECT p.page_id, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
           max_by(r.verdict, length(r.host || r.path)) AS verdict
    FROM parts p JOIN rules r
      ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b USING (page_id)
"""

"""Answers to saved questions as files and as text, each with its citation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.plans.manifest import QUESTIONS, ask, citation
from tracewell.relations import Store
from tracewell.storage import Folder

#: Rows of a table of text, which the driver holds.
TABLE_ROWS = 1000


@dataclass(frozen=True)
class Answer:
    """Rows, the line that names the question and its parameters, and of a corpus question how many sessions belong to no project."""

    rows: DataFrame
    citation: str
    unplaced: int | None

    @property
    def remarks(self) -> list[str]:
        """What stands beside the rows: the citation, and sessions that no project's answer counts."""
        left = [f"{self.unplaced} sessions without a project are not counted"] if self.unplaced else []
        return [self.citation, *left]

    def flat(self) -> DataFrame:
        """The rows with lists and maps as JSON text, for forms that have none."""
        nested = [c for c, kind in self.rows.dtypes if kind.startswith(("array", "map", "struct"))]
        return self.rows.withColumns({c: F.to_json(F.col(c)) for c in nested}) if nested else self.rows

    def write_csv(self, path: str) -> None:
        """Write the rows as CSV files with headers below ``path``, and the remarks beside them in ``_remarks.txt``.

        Nulls are empty and empty texts are quoted, so that they differ; quotes
        within texts are doubled. Readers of the folder pass over the remarks.
        """
        self.flat().write.mode("overwrite").options(header=True, quote='"', escape='"', nullValue="", emptyValue='""').csv(path)
        Folder(self.rows.sparkSession, path).claim("_remarks.txt", "\n".join([*self.remarks, ""]))

    def as_table(self, max_rows: int = TABLE_ROWS) -> str:
        """The first ``max_rows`` rows in columns of text under the remarks; the last line tells whether more were left out."""
        some = self.flat().limit(max_rows + 1).collect()
        shown = [["" if x is None else " ".join(str(x).splitlines()) for x in row] for row in some[:max_rows]]
        table = [self.rows.columns, *shown]
        width = [max(map(len, column)) for column in zip(*table, strict=True)]
        text = ["  ".join(x.ljust(w) for x, w in zip(row, width, strict=True)).rstrip() for row in table]
        more = [f"... and more than these {max_rows} rows"] if len(some) > max_rows else []
        return "\n".join([*self.remarks, text[0], "  ".join("-" * w for w in width), *text[1:], *more])


def answer(store: Store, name: str, /, **given) -> Answer:
    """Ask a saved question, and keep beside its rows what must be told with them."""
    rows = ask(store, name, **given)
    unplaced = store["sessions"].where("project_dir IS NULL").count() if QUESTIONS[name].corpus else None
    return Answer(rows, citation(name, **given), unplaced)

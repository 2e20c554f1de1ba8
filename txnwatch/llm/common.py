"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from itertools import chain, islice

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.session import give_back, ship_package, work_dir  # noqa: F401

#: Space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[ \t-\r]+"
_BLANK_THEN_SPACE = re.compile(r"\s ")
#: From a space that follows no blank to the next such space.
_STRETCH = re.compile(r" \s*(?:\S+(?:[^\S ]\s*\S+)*(?:[^\S ]\s*)?)?")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later
    steps neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` to be joined by sort-merge.  Spark sizes a stored table by its compressed files and an explode or a
    Python function by its input, so what it takes for 10 MB, and broadcasts by way of the driver, may be a GB."""
    return df.hint("merge")


def python_ready(spark: SparkSession) -> None:
    """Make the package importable in Python workers (a no-op on a cluster)."""
    ship_package(spark)


def bind(value: Column, body) -> Column:
    """``body(v)`` with ``value`` evaluated once per row, however often ``v`` is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is a file table, or columns and rows picked from one."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("LogicalRelation", "Relation"))


def stored_rows(df: DataFrame) -> DataFrame:
    """``df`` itself where its rows have a place in a Parquet file, else a stored copy."""
    if _is_scan(df):
        try:
            df.select("_metadata.file_path", "_metadata.row_index")
            return df
        except AnalysisException:
            pass
    return written(df, "rows")


def with_row_id(df: DataFrame, name: str = "_row") -> DataFrame:
    """Columns of ``stored_rows`` with a key as text: the file that a row lies in (a hash of its path) and its
    place there.  It is the same in every plan, however the files are dealt to tasks."""
    place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    return df.withColumn(name, place)


def id_text(name: str) -> Column:
    """An id as text: pandas keeps it exact beside nulls (a long column with nulls would become
    double there).  Cast the result back with ``id_back``."""
    return F.col(name).cast("long").cast("string")


def id_back(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that no other column of the table can clash."""
    return df.select(*[F.col(n) for n in names])


def stretches(text: str) -> list[str]:
    """``text``, which begins with a space, cut before every space that follows a character that is no
    blank: places where the published byte-level split pattern always cuts."""
    if _BLANK_THEN_SPACE.search(text):
        return _STRETCH.findall(text)
    return [" " + part for part in text[1:].split(" ")]         # every space is a cut


def one_thread() -> None:
    """Keep the ``tokenizers`` library from starting threads of its own inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def distinct(split: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """The distinct words of all lists, and for every occurrence in turn its place among them."""
    place: defaultdict = defaultdict()
    place.default_factory = place.__len__
    code = np.fromiter(map(place.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
    return code, list(place)


class Memory:
    """What a worker has worked out for words it has seen, in columns, one row a word in order of first sight;
    ``flat`` columns hold several values a word, found by ``start`` and ``size``.  It is emptied when it holds more
    than ``limit`` words, between two calls."""

    def __init__(self, limit: int = 1 << 18):
        self.limit = limit
        self._empty()

    def _empty(self):
        self.place: defaultdict = defaultdict()
        self.place.default_factory = self.place.__len__
        self.columns: dict = {}

    def codes(self, split: list[list[str]]) -> tuple[np.ndarray, list[str]]:
        """For every word in turn its row, and the words whose rows are still to be added."""
        if len(self.place) > self.limit:
            self._empty()
        before = len(self.place)
        code = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        return code, list(islice(self.place, before, None))

    def add(self, **columns) -> None:
        for name, values in columns.items():
            old = self.columns.get(name)
            self.columns[name] = values if old is None else old + values if isinstance(values, list) else np.concatenate([old, values])

    def __getitem__(self, name: str):
        return self.columns[name]

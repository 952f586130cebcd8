"""Sources given as SQL text or as a named dataset with parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Dataset = Callable[[SparkSession, Mapping[str, str]], DataFrame]


def source_query(spark: SparkSession, query: str, **tables: DataFrame) -> DataFrame:
    """Any SELECT. ``{name}`` in the text stands for the table passed under that name."""
    return spark.sql(query, **tables)


def parse_parameters(pairs: Iterable[str]) -> dict[str, str]:
    """``name=value`` texts as a mapping.

    Blank texts are skipped, a text without ``=`` gets an empty value, names ignore
    case and the last one wins.
    """
    values: dict[str, str] = {}
    spelling: dict[str, str] = {}
    for pair in pairs:
        name, _, value = (pair or "").partition("=")
        if not name.strip():
            # "=x" names nothing before the sign, so the whole text is the name.
            name, value = (pair or ""), ""
        name = name.strip()
        if name:
            values[spelling.setdefault(name.lower(), name)] = value.strip()
    return values


_MARKER = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(?<![:\w]):(\w+)", re.DOTALL)


def source_params(
    spark: SparkSession, query: str, parameters: Mapping[str, str], tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """A SELECT with ``:name`` markers.

    A leading ``@`` of a name is dropped and its case ignored, in the parameters and in the
    query; of names that then agree the last one counts. Blank names are skipped.
    """
    values = {}
    for name, value in parameters.items():
        plain = (name or "").strip().lstrip("@").lower()
        if plain:
            values[plain] = value or ""

    def lower(marker: re.Match) -> str:
        return marker[0] if marker[1] is None else f":{marker[1].lower()}"

    return spark.sql(_MARKER.sub(lower, query), args=values, **(tables or {}))


class DatasetRegistry:
    """Named, parameterised sources: the place of stored procedures."""

    def __init__(self) -> None:
        self._datasets: dict[str, Dataset] = {}

    def add(self, name: str, dataset: Dataset) -> None:
        self._datasets[name.lower()] = dataset

    def read(self, spark: SparkSession, name: str, parameters: Mapping[str, str] | None = None) -> DataFrame:
        if name.lower() not in self._datasets:
            raise ValueError(f"no dataset is registered as {name!r}")
        return self._datasets[name.lower()](spark, parameters or {})


def read_source(
    spark: SparkSession,
    query: str | None = None,
    dataset: str | None = None,
    parameters: Mapping[str, str] | None = None,
    *,
    registry: DatasetRegistry | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """A job's source: its query where it has one, else its named dataset."""
    if (query or "").strip():
        return source_params(spark, query, parameters or {}, tables)
    if (dataset or "").strip() and registry is not None:
        return registry.read(spark, dataset, parameters)
    raise ValueError("a source needs a query or a registered dataset")


def source_params_json(text: Column) -> Column:
    """Parameters stored as a JSON object; bad JSON gives no parameters."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def source_top_n(df: DataFrame, n: int, order_by: Iterable[Column] = ()) -> DataFrame:
    """The first ``n`` rows of any source; ``n`` below 1 means all of them."""
    if n <= 0:
        return df
    ordering = list(order_by)
    return (df.orderBy(*ordering) if ordering else df).limit(n)

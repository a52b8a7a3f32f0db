"""Parquet tables, guarded read-only SQL, and schema reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import QueryError


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``; NaN in its top-level doubles means absent."""
    return without_nan(spark.read.parquet(f"{folder}/{name}.parquet"))


def scan(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as it is stored: filters on all of its columns reach the scan. ``where``, orders and facets take NaN as absent by themselves."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and null are both absent: make them one."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def validate(spark: SparkSession, sql: str) -> list[str]:
    """Output columns of a statement that is analysed but not run."""
    try:
        return spark.sql(f"SELECT * FROM ({sql}) LIMIT 0").columns
    except (AnalysisException, ParseException) as e:
        raise QueryError("invalid_sql", str(e).splitlines()[0]) from e


def execute(spark: SparkSession, sql: str, *values) -> DataFrame:
    """One statement with positional values."""
    return spark.sql(sql, args=list(values)) if values else spark.sql(sql)


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a statement only reads, decided on its parsed plan: no command and no insert anywhere in it."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise QueryError("invalid_sql", str(e).strip().splitlines()[0]) from e
    kinds = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{k}") for k in ("Command", "ParsedStatement")]
    todo = [plan]
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return False
        below = node.children()
        todo += [below.apply(i) for i in range(below.size())]
    return True


def execute_many(spark: SparkSession, statements: list[tuple], most: int = 100) -> list[DataFrame]:
    """Several read-only statements; all are judged before the first runs, and anything but a query is refused."""
    if len(statements) > most:
        raise QueryError("operation_too_large", f"at most {most} statements")
    for sql, *_ in statements:
        if not is_query(spark, sql.rstrip("; \n")):
            raise QueryError("exec_many_not_read_only", sql[:80])
    return [execute(spark, sql.rstrip("; \n"), *values) for sql, *values in statements]


def tagged(spark: SparkSession, *parts) -> DataFrame:
    """A statement from texts and values in turn: every second part is bound, never pasted into the text."""
    return execute(spark, "?".join(parts[::2]), *parts[1::2])


def schema_sql(name: str, df: DataFrame) -> str:
    """The table's schema as DDL text."""
    return f"CREATE TABLE {name} ({df.schema.toDDL()})"


def drift(declared: DataFrame, actual: DataFrame) -> list[tuple[str, str, str]]:
    """(column, declared type, actual type) where two schemas differ; '' for a missing column."""
    a, b = dict(declared.dtypes), dict(actual.dtypes)
    return [(c, a.get(c, ""), b.get(c, "")) for c in [*a, *(x for x in b if x not in a)] if a.get(c) != b.get(c)]

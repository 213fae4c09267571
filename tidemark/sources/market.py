"""Market data: files in and out, ticks to bars, and a canonical, checked form of bars."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

TICKS = T.StructType([T.StructField("datetime", T.TimestampNTZType()), T.StructField("price", T.DoubleType()), T.StructField("qty", T.DoubleType())])
BARS = "symbol string, datetime timestamp, open double, high double, low double, close double, volume double"


def load(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A .parquet or .csv (with a header) by its suffix."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    raise ValueError(f"neither .parquet nor .csv: {path}")


def save(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.rstrip("/").endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"neither .parquet nor .csv: {path}")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """What the file holds; where there is none, fetch() writes it first."""
    if not exists(spark, path):
        save(fetch(), path)
    return load(spark, path)


def read_many(symbols: Sequence[str], read_one: Callable[[str], DataFrame], symbol: str = "symbol") -> tuple[DataFrame | None, dict[str, str]]:
    """(one long frame, why each symbol that is missing failed)."""
    out, failed = None, {}
    for s in symbols:
        try:
            part = read_one(s).withColumn(symbol, F.lit(s))
        except Exception as e:  # a reader may fail in any way; the others go on
            failed[s] = str(e)
            continue
        out = part if out is None else out.unionByName(part)
    return out, failed


def date_range(start: str, end: str) -> list[str]:
    """Days of an inclusive range of YYYY-MM-DD dates."""
    a, b = (datetime.date.fromisoformat(x) for x in (start, end))
    if a > b:
        raise ValueError("the range ends before it starts")
    return [(a + datetime.timedelta(n)).isoformat() for n in range((b - a).days + 1)]


def bars(ticks: DataFrame, interval: str = "1 hour", price: str = "price", qty: str | None = "qty", time: str = "datetime", tie: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, datetime, open, high, low, close, volume) of intervals with ticks, named by their start. Of ticks at one
    time the tie column says which is first. Works on a stream with a watermark as well."""
    w = F.window(F.col(time), interval)
    at = F.struct(time, tie) if tie else F.col(time)
    made = [F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close")]
    if qty:
        made.append(F.sum(qty).alias("volume"))
    return ticks.groupBy(*by, w.alias("__w")).agg(*made).select(*by, F.col("__w.start").alias("datetime"), "open", "high", "low", "close", *(["volume"] if qty else []))


def load_ohlc_range(spark: SparkSession, symbol: str, interval: str, start: str, end: str, folder: str) -> DataFrame:
    """Bars of daily tick files {folder}/{symbol}-trades-{day}.csv; missing days are left out, none at all is an error."""
    paths = [f"{folder}/{symbol}-trades-{d}.csv" for d in date_range(start, end)]
    there = [p for p in paths if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"no data for {symbol} from {start} to {end}")
    ticks = spark.read.option("header", True).schema(TICKS).csv(there)
    return bars(ticks, interval).withColumn("symbol", F.lit(symbol))


def daily_bars(ticks: DataFrame, interval: str, by: Sequence[str] = ("symbol",), **options) -> DataFrame:
    """bars() of each day by itself."""
    time = options.get("time", "datetime")
    return bars(ticks.withColumn("__day", F.to_date(time)), interval, by=(*by, "__day"), **options).drop("__day")


def read_range(df: DataFrame, symbols: Sequence[str], start: str, end: str, time: str = "datetime") -> DataFrame:
    """Rows of the symbols in an inclusive range; both conditions reach the scan."""
    return df.where(F.col("symbol").isin(list(symbols)) & F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def read_table(spark: SparkSession, name: str, symbol: str, start: str, end: str) -> DataFrame:
    return read_range(spark.table(checked_name(name)), [symbol], start, end)


def write_table(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(checked_name(name))


#: Daily files of trades as exchanges publish them.
TRADES = "id long, price double, qty double, quote_qty double, time long, is_buyer_maker boolean"


def landed_trades(spark: SparkSession, symbol: str, start: str, end: str, folder: str) -> DataFrame:
    """Trades of landed files {folder}/{symbol}-trades-{day}.csv with their time as datetime; days without a file are left out. Downloading
    them is somebody else's work."""
    there = [p for p in (f"{folder}/{symbol}-trades-{d}.csv" for d in date_range(start, end)) if exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"no data for {symbol} from {start} to {end}")
    return spark.read.option("header", True).schema(TRADES).csv(there).withColumn("datetime", F.timestamp_millis("time"))


def read_bars(spark: SparkSession, symbols: Sequence[str], start: str, end: str, interval: str, folder: str) -> tuple[DataFrame | None, dict[str, str]]:
    """(bars of each symbol's landed trades, each day by itself; why symbols are missing)."""
    ticks, failed = read_many(symbols, lambda s: landed_trades(spark, s, start, end, folder))
    return (daily_bars(ticks, interval, tie="id") if ticks is not None else None), failed


def checked_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a table name: {name}")
    return name


def normalize_timestamps(df: DataFrame, time: str = "datetime", timezone: str | None = "UTC", ambiguous: str = "raise", nonexistent: str = "raise") -> DataFrame:
    """Naive times of a zone as UTC instants. A time that the zone skips or has twice is an error, or null with 'null'."""
    if timezone is None:
        return df
    naive = F.col(time).cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(timezone), F.lit("UTC"), naive)
    back = F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)
    hour = F.expr("interval 1 hour")
    twice = F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc + hour) == naive
    twice = twice | (F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc - hour) == naive)
    none = F.lit(None).cast("timestamp_ntz")
    fault = lambda how, what: none if how == "null" else F.raise_error(F.lit(what)).cast("timestamp_ntz")
    out = F.when(back != naive, fault(nonexistent, "a time that the zone skips")).when(twice, fault(ambiguous, "a time that the zone has twice")).otherwise(utc)
    return df.withColumn(time, F.to_utc_timestamp(out.cast("timestamp"), "UTC"))


def deduplicate(df: DataFrame, subset: Sequence[str] = ("symbol", "datetime"), keep: str | bool = "last", seq: str = "_seq") -> DataFrame:
    """One row for each key: the first or the last by `seq`, the rows' order of arrival; with keep=False only keys that have one."""
    if keep is False:
        return df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*subset))).where("__n = 1").drop("__n")
    order = F.col(seq).desc() if keep == "last" else F.col(seq).asc()
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*subset).orderBy(order))).where("__n = 1").drop("__n")


def violations(df: DataFrame, time: str = "datetime", entity: Sequence[str] = ("symbol",), allow_missing: bool = False, seq: str | None = None) -> DataFrame:
    """One row: how many rows break each rule of bars."""
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    bad = lambda cond: F.coalesce(F.count_if(cond), F.lit(0))
    each = [o, h, l, c, v]
    missing, infinite = F.lit(False), F.lit(False)
    for x in each:
        missing, infinite = missing | x.isNull() | F.isnan(x), infinite | (F.abs(x) == float("inf"))
    rows = df.withColumn("__twice", F.count(F.lit(1)).over(Window.partitionBy(*entity, time)) > 1)
    if seq:
        rows = rows.withColumn("__back", F.col(time) < F.lag(time, 1).over(Window.partitionBy(*entity).orderBy(seq)))
    else:
        rows = rows.withColumn("__back", F.lit(False))
    return rows.agg(
        bad(missing).alias("missing") if not allow_missing else F.lit(0).alias("missing"), bad(infinite).alias("infinite"), bad(h < F.greatest(o, c)).alias("high_below_body"), bad(l > F.least(o, c)).alias("low_above_body"),
        bad(h < l).alias("high_below_low"), bad(v < 0).alias("negative_volume"), bad(F.col("__twice")).alias("repeated"), bad(F.col("__back")).alias("unordered"),
    )


def validate_ohlcv(df: DataFrame, **options) -> DataFrame:
    """`df`, if its columns are there and numeric and no row breaks a rule; otherwise ValueError with the counts."""
    kinds = dict(df.dtypes)
    for c in ("open", "high", "low", "close", "volume"):
        if c not in kinds:
            raise ValueError(f"no column {c}")
        if kinds[c] not in ("double", "float", "int", "bigint", "smallint") and not kinds[c].startswith("decimal"):
            raise ValueError(f"{c} is not numeric")
    found = {k: n for k, n in violations(df, **options).first().asDict().items() if n}
    if found:
        raise ValueError(f"invalid bars: {found}")
    return df


def detect_gaps(df: DataFrame, seconds: int, time: str = "datetime", entity: Sequence[str] = ("symbol",)) -> DataFrame:
    """(entity, gap_start, gap_end, missing_count): neighbours with regular times missing between them."""
    rows = df.select(*entity, time).distinct()
    after = F.lead(time, 1).over(Window.partitionBy(*entity).orderBy(time))
    apart = (F.unix_micros(F.col("gap_end").cast("timestamp")) - F.unix_micros(F.col("gap_start").cast("timestamp"))) / 1_000_000
    rows = rows.select(*entity, F.col(time).alias("gap_start"), after.alias("gap_end"))
    return rows.withColumn("missing_count", (F.ceil(apart / seconds) - 1).cast("long")).where("missing_count > 0")


#: Other names of columns.
ALIASES = {"date": "datetime", "timestamp": "datetime", "ticker": "symbol", "adj_close": "adjusted_close"}


def canonical_names(columns: Sequence[str], column_map: dict[str, str] | None = None) -> list[str]:
    out = []
    for c in columns:
        name = (column_map or {}).get(c, c).strip().lower().replace(" ", "_").replace("-", "_")
        out.append(ALIASES.get(name, name))
    if len(set(out)) < len(out):
        raise ValueError(f"columns clash: {out}")
    return out


def canonicalize_ohlcv(df: DataFrame, column_map: dict[str, str] | None = None, timezone: str | None = "UTC", duplicate_keep: str | bool = "last", allow_missing: bool = False, seq: str | None = None) -> DataFrame:
    """Bars with canonical names and types, UTC times and one row for each symbol and time, checked."""
    names = canonical_names(df.columns, column_map)
    out = df.toDF(*names)
    for c in ("open", "high", "low", "close", "volume"):
        out = out.withColumn(c, F.col(c).cast("double"))
    out = normalize_timestamps(out.withColumn("datetime", F.col("datetime").cast("timestamp_ntz")), timezone=timezone)
    if seq:
        out = deduplicate(out, keep=duplicate_keep, seq=canonical_names([seq])[0])
    return validate_ohlcv(out, allow_missing=allow_missing)


def non_trading_days_after(dates: DataFrame, sessions: DataFrame, date: str = "date") -> DataFrame:
    """`dates` with the days without a session between each and the next; sessions (session) is the exchange's calendar. A date that is
    none is an error."""
    w = Window.orderBy("session")
    table = sessions.select("session", (F.datediff(F.lead("session", 1).over(w), "session") - 1).alias("non_trading_days"), F.lit(True).alias("__there"))
    out = dates.join(table, F.col(date) == F.col("session"), "left")
    there = F.when(F.col("__there"), F.col("non_trading_days")).otherwise(F.raise_error(F.lit("not a session")).cast("int"))
    return out.withColumn("non_trading_days", there).drop("session", "__there")


def column_subset(df: DataFrame, patterns: Sequence[str]) -> list[str]:
    """Columns that match shell-style patterns, in their order."""
    from fnmatch import fnmatchcase

    return [c for c in df.columns if any(fnmatchcase(c, p) for p in patterns)]

"""URL filters: listed host and path rules, then association rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import staged, table

#: Fixed values: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What mining and pruning ask for: a share of the labelled URLs; a share of a combination's URLs if all classes were as many; tokens.
SUPPORT, CONFIDENCE, LONGEST = 0.002, 0.6, 3
#: URLs with a rule and its label, however few are labelled; deviations by which the rule's share of its label is above the class's own.
LEAST, SURE = 10, 1.645
#: Items of one URL up to which it is dealt without a look at their pairs; how many are side by side in a transaction.
ITEMS, PAIR = 40, 2
#: Rows of a few tokens, some MB, up to which rules and frequent tokens are broadcast; beyond it the joins shuffle.
BROADCAST = 100_000


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """`df` with host (after the first ://, up to / ? # or the end, A-Z lower-cased) and path (then up to ? # or the
    end); both are empty where the URL is null or has no ://."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substr(F.col(url_col), at + 3)).otherwise(F.lit(""))
    out = df.withColumn("__rest", F.coalesce(rest, F.lit("")))
    host = F.translate(F.regexp_extract("__rest", r"^([^/?#]*+)", 1), _UPPER, _UPPER.lower())
    return out.withColumn("host", host).withColumn("path", F.regexp_extract("__rest", r"^[^/?#]*+([^?#]*+)", 1)).drop("__rest")


def listed(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits host and path, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(url_col: str = "url") -> Column:
    """What a URL is made of, each once: scheme, host, its labels, path segments and query keys; numbers are one token."""
    scheme = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*+)://", 1)
    query = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"\?([^#]*+)", 1)
    number = r"^[0-9]++"
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("label:"), x))
    segments = F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, number, "0")))
    keys = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    every = F.concat(F.array(F.concat(F.lit("scheme:"), F.lower(scheme)), F.concat(F.lit("host:"), F.col("host"))), labels, segments, keys)
    return F.array_distinct(F.filter(every, lambda x: ~F.endswith(x, F.lit(":"))))


def _sized(df: DataFrame) -> DataFrame:
    """A staged table, broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _transactions(items: str, label: str, longest: int, side: int = PAIR, first: str = "") -> str:
    """Arrays of a few items and the label, of which one at least holds any `longest` of the items: `side` items are put
    together, and every `longest` of these groups are one transaction, after the items `first` where given."""
    groups = f"transform(sequence(0, (size({items}) - 1) div {side}), g -> slice({items}, g * {side} + 1, {side}))"
    begin = [first] if first else []

    def chosen(level: int, parts: list[str]) -> str:
        if level == longest:
            return f"array(array_append(concat({', '.join(parts)}), {label}))"
        after = f"x{level - 1}" if level else "-1"
        inner = chosen(level + 1, [*parts, f"element_at(groups, x{level} + 1)"])
        return f"flatten(transform(filter(sequence(0, size(groups) - 1), y -> y > {after}), x{level} -> {inner}))"

    many = chosen(0, begin).replace("groups", f"({groups})")
    none = f"array(array_append({first}, {label}))" if first else "array()"
    return f"CASE WHEN size({items}) = 0 THEN {none} WHEN size({items}) <= {side * longest} THEN array(array_append(concat({', '.join([*begin, items])}), {label})) ELSE {many} END"


def _pairs(rows: DataFrame) -> DataFrame:
    """(row, label, i, j, a, b) for any two items of a row: places and names, the more frequent item first."""
    first = rows.select("row", "label", "items", F.posexplode("items").alias("i", "a"))
    second = first.select("row", "label", "i", "a", F.posexplode(F.expr("slice(items, i + 2, size(items))")).alias("k", "b"))
    return second.select("row", "label", "i", (F.col("i") + F.col("k") + 1).alias("j"), "a", "b")


def _long_transactions(rows: DataFrame, need: int, longest: int) -> DataFrame:
    """(items): transactions of URLs with more than ITEMS items, of which one at least holds any `longest` items that may be a
    rule's: those of which any two are in `need` URLs of the row's label. Two such items are dealt with those after them
    that go with both."""
    often = _pairs(rows).groupBy("label", "a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= need).drop("n")
    own = rows.where(F.size("items") > ITEMS)
    near = _pairs(own).join(_sized(staged(often, "pairs")), ["label", "a", "b"]).groupBy("row", "i").agg(F.sort_array(F.collect_list("j")).alias("near"))
    near = near.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("i", "near"))).alias("by"))
    near = own.join(near, "row").select("tag", "items", F.expr("transform(sequence(0, size(items) - 1), i -> coalesce(by[i], array()))").alias("near"))
    more = max(0, longest - 2)
    dealt = _transactions("both", "tag", more, 2 * (longest - 1) // max(1, more), "array(items[i], items[j])")
    both = "transform(array_intersect(near[i], near[j]), k -> items[k])"
    every = f"flatten(transform(near[i], j -> flatten(transform(array({both}), both -> {dealt}))))"
    each = staged(near, "near").select("*", F.explode(F.expr("sequence(0, size(items) - 1)")).alias("i"))
    return each.select(F.explode(F.expr(every)).alias("items"))


def _indexed(rules: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """The inverted index: each rule under one of its tokens, the rarest where counts are given, else the last."""
    if often is None:
        return rules.select(F.element_at("tokens", -1).alias("token"), F.slice("tokens", 1, F.size("tokens") - 1).alias("others"), *rules.columns)
    by = rules.select("*", F.explode("tokens").alias("t")).join(often.select(F.col("item").alias("t"), "n"), "t")
    by = by.groupBy(*rules.columns).agg(F.min(F.struct("n", "t")).alias("least"))
    return by.select(F.col("least.t").alias("token"), F.array_remove("tokens", F.col("least.t")).alias("others"), *rules.columns)


def mined(labelled: DataFrame, url_col: str = "url", label_col: str = "label", support: float = SUPPORT, confidence: float = CONFIDENCE, longest: int = LONGEST, least: int = LEAST, sure: float = SURE) -> DataFrame:
    """(tokens array<string>, verdict, confidence, support): combinations of at most `longest` tokens that go with a
    label, from URLs with a label that is not null.

    A rule has its label in at least `support` of the URLs, and `least` of them. Its confidence is the share of its label among
    its URLs if all labels together were as many as this one, so that a rare label has rules too; rules below
    `confidence` are pruned, and those whose share of the label is not above the label's own share of all URLs by `sure`
    deviations (Wilson's lower bound). So is a rule with no more confidence than one of fewer of its tokens for the same label.

    Tokens that occur in the same URLs are one item, named by the first of them, and rarer ones than the support are no
    items. FP-growth mines transactions of at most six items and the label, so that no longer combination is ever
    counted: a URL gives one for every three pairs of its items. Of more than ITEMS items only those are put together of which any two
    have the support with the URL's label, as those of any rule have: no combination is lost. Supports there are no less than
    the true ones; the combinations found are then counted once a URL through the index. URLs that are null or repeat are rows like any other; a table without labels gives no rules."""
    baskets = with_parts(labelled.where(F.col(label_col).isNotNull()).select(F.col(url_col).alias("url"), F.col(label_col).cast("string").alias("label")))
    baskets = staged(baskets.select("label", F.xxhash64("url", "label").cast("decimal(20)").alias("h"), tokens().alias("own")), "baskets")
    spark = labelled.sparkSession
    classes = {r.label: r["count"] for r in baskets.groupBy("label").count().collect()}
    total = sum(classes.values())
    shape = "tokens array<string>, verdict string, confidence double, support double"
    if len(classes) < 2:
        return spark.createDataFrame([], shape)
    need = max(least, math.ceil(support * total))
    often = baskets.select("h", F.explode("own").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).where(F.col("n") >= need)
    often = staged(often.withColumn("item", F.min("token").over(Window.partitionBy("n", "h"))).select("token", "item", "n"), "tokens")
    named = _sized(often)
    rows = baskets.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "label", F.explode("own").alias("token")).join(named, "token").where("token = item")
    rows = rows.groupBy("row", "label").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "item"))).getField("item").alias("items"))
    rows = staged(rows.withColumn("tag", F.concat(F.lit("="), "label")), "items")
    deals = rows.where(F.size("items") <= ITEMS).select(F.explode(F.expr(_transactions("items", "tag", longest))).alias("items"))
    if not rows.where(F.size("items") > ITEMS).isEmpty():
        deals = deals.union(_long_transactions(rows, need, longest))
    deals = staged(deals, "deals")
    if not (dealt := deals.count()):
        return spark.createDataFrame([], shape)
    # FPGrowth rounds its share of the transactions up: half a one less, lest a last digit asks for one more than `need`
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / dealt)).fit(deals).freqItemsets.select("items")
    label = F.filter("items", lambda x: F.startswith(x, F.lit("=")))
    plain = F.filter("items", lambda x: ~F.startswith(x, F.lit("=")))
    pairs = found.where(F.size(label) == 1).select(F.array_sort(plain).alias("tokens")).where((F.size("tokens") > 0) & (F.size("tokens") <= longest))
    single = often.where("token = item").select(F.array("item").alias("tokens"))
    index = _sized(staged(_indexed(pairs.union(single).distinct(), often), "candidates"))
    hits = rows.select("items", "label", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("others", "items")) == 0)
    counts = hits.groupBy("tokens", "label").count().groupBy("tokens").agg(F.sum("count").alias("n"), F.collect_list(F.struct("label", "count")).alias("by"))
    counts = counts.select("tokens", "n", F.explode("by").alias("x")).select("tokens", F.col("x.label").alias("verdict"), "n", F.col("x.count").alias("hits"))
    own = F.element_at(F.create_map(*(F.lit(x) for c in classes.items() for x in c)), F.col("verdict"))
    counts = counts.where(F.col("hits") >= need).withColumn("own", own)
    n, share = F.col("n"), F.col("hits") / F.col("n")
    here, else_ = F.col("hits") / F.col("own"), (n - F.col("hits")) / (F.lit(total) - F.col("own"))
    low = (share + sure * sure / (2 * n) - sure * F.sqrt(share * (1 - share) / n + sure * sure / (4 * n * n))) / (1 + sure * sure / n)
    rules = counts.withColumns({"confidence": F.round(here / (here + else_), 9), "low": low}).where((F.col("confidence") >= confidence) & (F.col("low") > F.col("own") / total))
    rules = staged(rules.select("tokens", "verdict", "confidence", (F.col("hits") / total).alias("support")), "rules")
    wider = rules.where(F.size("tokens") < longest).select(F.col("tokens").alias("w"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    # a wider rule shares each of its tokens with the narrower one: join by the first, then compare
    first = rules.select("*", F.explode("tokens").alias("lead"))
    beaten = first.join(wider.withColumn("lead", F.col("w")[0]), "lead")
    beaten = beaten.where((F.col("v") == F.col("verdict")) & (F.size("w") < F.size("tokens")) & (F.size(F.array_except("w", "tokens")) == 0) & (F.col("c") >= F.col("confidence")))
    return staged(rules.join(beaten.select("tokens", "verdict").distinct(), ["tokens", "verdict"], "left_anti"), "rules")


def matched(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, verdict, confidence, association) for each different URL that a mined rule fits: the one of most
    confidence, then support, then the first by its text and verdict. `rules` is a table that is read twice.

    The inverted index posts each rule under the last of its tokens alone; a URL looks up its own tokens and keeps the
    rules whose other tokens it has too. Null URLs have no tokens; without rules or URLs there are no rows."""
    own = with_parts(urls.select(F.col(url_col).alias("url")).where("url is not null").distinct()).select("url", tokens().alias("own"))
    index = _sized(_indexed(rules.select("tokens", "verdict", "confidence", "support", F.array_join("tokens", " ").alias("association"))))
    hits = own.select("url", "own", F.explode("own").alias("token")).join(index, "token").where(F.size(F.array_except("others", "own")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "association", "verdict"))
    return hits.groupBy("url").agg(best.alias("b")).select("url", "b.verdict", (-F.col("b.c")).alias("confidence"), "b.association")


def judged(pages: DataFrame, rules: DataFrame, url_col: str = "url", listed_rules=RULES, other: str = "allow") -> DataFrame:
    """Every row of `pages` with host, path, rule, verdict, association and confidence, in place of any columns so named.

    The longest listed rule that fits decides; else the best mined rule; else `other`. A null URL, or one without ://,
    has an empty host and path and gets `other` unless its tokens fit a mined rule. Rows may repeat; an empty table
    gives an empty result; without mined rules the listed ones decide."""
    made = ("host", "path", "rule", "verdict", "association", "confidence")
    rule, verdict = listed(listed_rules)
    rows = with_parts(pages.drop(*made), url_col)
    rows = rows.withColumns({"rule": rule, "__listed": verdict})
    found = matched(pages, rules, url_col).select(F.col("url").alias("__url"), F.col("verdict").alias("__mined"), "confidence", "association")
    rows = rows.join(found, F.col(url_col) == F.col("__url"), "left")
    return rows.withColumn("verdict", F.coalesce("__listed", "__mined", F.lit(other))).drop("__listed", "__mined", "__url")


def labelled_pages(spark, sf_dir: str) -> DataFrame:
    """(url, label): pages whose id has a quality label; low quality or toxic is block, else allow. A null toxic counts as
    not; without labels or pages there are no rows; ids that repeat give a row for each pair."""
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    label = F.when((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1), "block").otherwise("allow")
    return table(spark, sf_dir, "pages").join(labels, F.col("page_id") == F.col("doc_id")).select("url", label.alias("label"))

"""URL filters: stated rules, then association rules mined from labelled URLs (operator 9). DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, save

#: The stated rules of the production query, as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Share of all URLs that a combination needs, and share of a combination's URLs that need the verdict.
SUPPORT, CONFIDENCE = 0.002, 0.9
#: URLs that a combination needs at least, whatever the table's size.
LEAST = 5
#: Slots of the table that the items of tokens are looked up in.
SLOTS = 1024
_LABEL = "verdict="
_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, ties by name; null where none fits.

    A rule fits its host and all subdomains if the path starts with the rule's path. The rules are a stated list,
    so they are part of the expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    """A URL's distinct tokens: scheme, each label of the host with its place from the end, words of the path with their place, and query names."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    words = F.filter(F.split(path, "/"), lambda x: x != "")
    names = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    return F.array_distinct(
        F.concat(
            F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))),
            F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x)),
            F.filter(F.transform(words, lambda x, i: F.when(~x.rlike(r"\d"), F.concat(F.lit("path"), i.cast("string"), F.lit("="), F.lower(x)))), lambda x: x.isNotNull()),
            F.filter(F.transform(names, lambda x: F.when(x != "", F.concat(F.lit("query="), F.regexp_extract(x, r"(?s)^([^=]*)", 1)))), lambda x: x.isNotNull()),
        )
    )


def restated(rules: tuple[tuple[str, str, str], ...] = RULES) -> list[str]:
    """The tokens that the stated rules are made of: labels of their hosts and words of their paths. They only say again which rule decided."""
    out = set()
    for _, host, path in rules:
        out |= {f"host{i}={x}" for i, x in enumerate(reversed([x for x in host.split(".") if x]))}
        out |= {f"path{i}={x.lower()}" for i, x in enumerate([x for x in path.split("/") if x])}
    return sorted(out)


def items_of(baskets: DataFrame, least: int) -> DataFrame:
    """(item, tokens, freq) of the tokens that at least so many URLs have. Tokens that the same URLs have are one item, named by the first of them.

    Whether the same URLs have two tokens shows in their number and two sums of hashes of the distinct token sets.
    """
    same = baskets.groupBy(F.array_sort("_tokens").alias("t")).agg(F.count("*").alias("n"))
    mark = lambda seed: (F.xxhash64("t", F.lit(seed)).cast("decimal(20,0)") * F.col("n")).cast("decimal(38,0)")
    each = same.select(F.explode("t").alias("token"), "n", mark(1).alias("x"), mark(2).alias("y"))
    freq = each.groupBy("token").agg(F.sum("n").alias("freq"), F.sum("x").alias("x"), F.sum("y").alias("y")).where(F.col("freq") >= least)
    return freq.groupBy("freq", "x", "y").agg(F.min("token").alias("item"), F.array_sort(F.collect_list("token")).alias("tokens")).select("item", "tokens", "freq")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, urls: DataFrame | None = None) -> DataFrame:
    """(items, verdict, confidence, support, any, key) mined with FP-growth from rows with `_tokens` and a `_label` (null: not labelled).

    Unlabelled URLs count, too: a combination that is common among them doesn't reach the confidence. A combination
    needs `support` of all URLs and `least` of them; it has any number of items. Tokens that always occur together are one item. An item
    whose URLs all have one verdict is a rule that nothing can improve, and is not combined. `any` has the tokens of each item, of which a URL
    needs one. A rule is left out if a shorter one with a part of its items has the same verdict and is as sure. No rows, or fewer than `least`, give no rules.

    With `urls` (`_tokens`) all rules are found that are the best of some of these rows, by the order of best_rules(); others may be missing. A
    URL with an item of confidence 1 can only be decided otherwise by items of more labelled URLs than that one has (see contenders()).
    The result is a saved table.
    """
    n = labelled.count()
    needed = max(least, int(-(-support * n // 1)))
    found = save(items_of(labelled, needed), "url-items")
    named = entries(found.select(F.explode("tokens").alias("token"), "item"), "token", "item")
    rows = save(with_items(labelled, named).select("_label", "_items"), "url-baskets")
    counts = rows.select(F.explode("_items").alias("item"), "_label").where("_label is not null").groupBy("item", "_label").count()
    single = counts.join(found.select("item", "freq"), "item").select("item", F.col("_label").alias("verdict"), (F.col("count") / F.col("freq")).alias("confidence"), "count")
    single = save(single, "url-singles")
    alone = single.where((F.col("confidence") >= confidence) & (F.col("count") >= needed)).select(F.array("item").alias("items"), "verdict", "confidence", (F.col("count") / F.lit(n)).alias("support"))
    combined = single.groupBy("item").agg(F.max("confidence").alias("most")).where("most < 1").select("item")
    if urls is not None:
        combined = combined.join(contenders(with_items(urls, named), single), "item", "left_semi")
    combined = save(combined.agg(F.collect_list("item").alias("i")), "url-combined")
    baskets = rows.withColumn("_kept", combined.scalar()).select("_label", F.array_intersect("_items", "_kept").alias("_items"))
    baskets = baskets.select(F.when(F.col("_label").isNull(), F.col("_items")).otherwise(F.concat("_items", F.array(F.concat(F.lit(_LABEL), F.col("_label"))))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / n) if n else 1.0, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(_LABEL) & (F.size("consequent") == 1))
    rules = rules.select(F.array_sort("antecedent").alias("items"), F.regexp_replace(F.element_at("consequent", 1), "^" + _LABEL, "").alias("verdict"), "confidence", "support")
    rules = save(rules.where((F.size("items") > 1) & (F.round(F.col("support") * n) >= needed)).unionByName(alone), "url-mined")
    out = save(_keyed(_minimal(rules), found), "url-rules")
    forget(found, rows, single, combined, rules)
    return out


def with_items(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Adds `_items`, the distinct items of the rows' `_tokens`; named: entries() of the items by their tokens."""
    items = F.array_distinct(F.filter(F.transform("_tokens", lambda t: look_up(F.col("_named"), t)), lambda e: e.isNotNull()))
    return rows.withColumn("_named", named.scalar()).withColumn("_items", items).drop("_named")


def contenders(urls: DataFrame, single: DataFrame) -> DataFrame:
    """(item): items that can be part of a combination that is the best rule of one of the rows with `_items`. single: (item, verdict, confidence, count).

    If a row has an item of confidence 1, a combination decides it only if it has this confidence and more URLs, and so each of its
    items has more URLs of some verdict. Otherwise all items of the row can be part of one.
    """
    figures = single.groupBy("item").agg(F.struct(F.max(F.when(F.col("confidence") == 1, F.col("count"))).alias("sure"), F.max("count").alias("most")).alias("f"))
    rows = urls.withColumn("_figures", entries(figures, "item", "f").scalar())
    rows = rows.select(F.transform("_items", lambda i: F.struct(i.alias("item"), look_up(F.col("_figures"), i).alias("f"))).alias("x"))
    beat = F.coalesce(F.array_max(F.transform("x", lambda e: e["f"]["sure"])), F.lit(0))
    return rows.withColumn("beat", beat).select(F.explode(F.filter("x", lambda e: e["f"]["most"] > F.col("beat"))["item"]).alias("item")).distinct()


def _minimal(rules: DataFrame) -> DataFrame:
    """Leaves out rules that a rule with one item less makes needless; chains of such rules end at the shortest."""
    less = rules.select(F.explode("items").alias("_x"), "items", "verdict", "confidence").select(F.array_except("items", F.array("_x")).alias("_part"), "items", "verdict", "confidence")
    short = rules.select(F.col("items").alias("_part"), "verdict", F.col("confidence").alias("_sure"))
    needless = less.join(short, ["_part", "verdict"]).where(F.col("_sure") >= F.col("confidence")).select("items", "verdict").distinct()
    return rules.join(needless, ["items", "verdict"], "left_anti")


def _keyed(rules: DataFrame, found: DataFrame) -> DataFrame:
    """Adds `any`, the tokens of each item, and `key`, the tokens of the rarest one: the index is inverted by them."""
    items = rules.select(F.explode("items").alias("item"), "items", "verdict").join(found, "item")
    more = items.groupBy("items", "verdict").agg(F.array_sort(F.collect_list("tokens")).alias("any"), F.min_by("tokens", F.struct("freq", "item")).alias("key"))
    return rules.join(more, ["items", "verdict"])


def entries(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One row, one array of SLOTS arrays of (key, value): a hash table for look_up().

    What goes into it is bounded by the support, not by the table's size: items that enough URLs have.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    slots = rows.groupBy(slot.alias("slot")).agg(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias("e"))
    every = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot")).join(slots, "slot", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "e"))), lambda s: s["e"]).alias("slots"))


def look_up(table: Column, key: Column) -> Column:
    """The value under a key, null if there is none."""
    here = F.get(table, F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int"))
    return F.get(F.filter(here, lambda e: e["key"] == key), 0)["value"]


def best_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(_url, best): of the rules that fit each row of `urls` (_url, _tokens) the surest one; ties by support, then fewer items, then verdict.

    Rules and URLs meet in a join by a token of the rule's rarest item, so neither has to fit into a task.
    """
    rule = F.struct("confidence", "support", (-F.size("items")).alias("less"), "verdict", "items")
    keyed = rules.select(F.explode("key").alias("_token"), rule.alias("_rule"), "any")
    met = urls.select("_url", "_tokens", F.explode("_tokens").alias("_token")).join(keyed, "_token")
    fits = met.where(F.forall("any", lambda x: F.arrays_overlap(x, F.col("_tokens"))))
    return fits.groupBy("_url").agg(F.max("_rule").alias("best"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, default: str = "allow", support: float = SUPPORT, confidence: float = CONFIDENCE, id_col: str = "page_id", url_col: str = "url", labelled_only: bool = False) -> DataFrame:
    """(id, host, path, rule, verdict, mined): the stated rule's verdict, else the surest mined rule's, else the default.

    URLs that a stated rule decides are the labelled ones. With labelled_only the rules are mined from these alone,
    so support and confidence are shares of labelled URLs, and from tokens that no stated rule is made of;
    without, undecided URLs count against a combination's confidence. `mined` tells the items of
    the mined rule that fits best (confidence, then support, fewer items, verdict), null without one. A null URL has empty host and path
    and gets the default. Repeated rows give repeated rows; an empty table none.
    """
    rows = pages.select(id_col, F.col(url_col).alias("_url")).withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    rows = rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_tokens", F.when(F.col("_url").isNotNull() & (F.col("host") != ""), tokens(F.col("_url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    baskets = rows.select("_tokens", F.col("_rule.verdict").alias("_label"))
    if labelled_only:
        again = F.array(*map(F.lit, restated(rules))).cast("array<string>")
        baskets = baskets.where(F.col("_label").isNotNull()).withColumn("_tokens", F.array_except("_tokens", again))
    open_ = rows.where(F.col("_rule").isNull() & (F.size("_tokens") > 0)).select("_url", "_tokens").dropDuplicates(["_url"])
    known = mine(baskets, support, confidence, urls=open_)
    rows = rows.join(best_rules(open_, known), "_url", "left").withColumn("_best", F.when(F.col("_rule").isNull(), F.col("best")))
    return rows.select(id_col, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "_best.verdict", F.lit(default)).alias("verdict"), F.array_join("_best.items", " ").alias("mined"))

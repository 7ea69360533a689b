"""URL filters from a tree of path templates.

Every host's paths form a tree of segments, grown level by level from the host, as deep as the paths go:

* segments that all paths below a node share are taken at once (a chain of any length is one level);
* a node whose labels can't support a split is finished: it has none, all are alike, or there are so few (under
  ``ALIKE`` squared) that no division of them, not even of good from bad ones, passes the test below. Its template ends
  in ``**`` and stands for every path below it, as splitting it further could tell nothing apart;
* a node under which too many different segments hang (``VARIABLE``, ``HELD``, ``MOST``) is variable: its children become
  one wildcard, ``*``. Segments that are mostly digits are written ``#`` beforehand, with their extension kept;
* else the children are sorted by their labelled purity and walked: a child that can't be told from the group before it
  (a two-proportion test, with the normal bound ``ALIKE``) joins it, so that their labels count together. Groups of more
  than one are written ``~1``, ``~2``, ... by rising purity. Children without any label are one group, ``~``: nothing
  is known of them, and no other's labels speak for them.

A finished template is rejected when its smoothed purity, the share of labelled urls that are bad with its host's share
(itself smoothed by that of all hosts) as ``STRENGTH`` earlier observations, passes ``REJECT``. Labels are what the
caller gives; rules that are certain override the tree.

All counts are aggregated before a shuffle. Nodes, paths and hosts are known by digests of fixed size. What is learned of
a node is joined to what hangs under it; nodes that hold a thousandth of the rows or more, of which there can't be more
than a thousand, are broadcast, so no host fills one task. What is finished leaves the search; a level costs what is left.

Defined results: null urls, and those without ``://``, have empty host and path and no rule, and are one host like any
other; paths of any depth and hosts of any length are read whole; a literal segment that begins with ``*`` or ``~`` is
written percent-encoded in a template; without labels everything is allowed; repeated rows count each; an empty table
gives no rows; null ids are kept. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import join_hot, materialise, new_path, table

#: A node is variable with more than so many different child segments, unless each holds at least so many urls on average; with more than MOST it always is.
VARIABLE, HELD, MOST = 12, 50, 1000
ALIKE, STRENGTH, REJECT = 1.96, 8.0, 0.5
#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(after, F.length(host) + 1, F.length(after)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Many rules cost no more than few."""
    by_host: dict[str, list] = {}
    for h, p, verdict in rules:
        by_host.setdefault(h, []).append((h, p, verdict))
    kind = "array<struct<n:int,rule:string,verdict:string,path:string>>"
    known = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path")) for h, p, v in found]))])
    # Only suffixes with as many labels as some rule's host are made, so a host of thousands of labels costs no more.
    labels = sorted({len(h.split(".")) for h in by_host})

    def ends(parts: Column) -> Column:
        return F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in labels])

    suffixes = F.array_compact(F.transform(F.array(F.split(host, r"\.")), ends)[0])
    fits = F.flatten(F.transform(suffixes, lambda s: F.filter(F.coalesce(F.try_element_at(known, s), F.array().cast(kind)), lambda r: path.startswith(r["path"]))))
    return F.array_max(fits)


def segments(path: Column) -> Column:
    """The path's segments; those mostly of digits are ``#`` with their extension, and no other begins with a mark."""
    cut = F.filter(F.split(path, "/"), lambda s: s != "")
    digits = lambda s: s.rlike(r"^\d+(\.[a-z]{1,5})?$") | (F.length(F.regexp_replace(s, r"\d", "")) * 2 < F.length(s))
    literal = lambda s: F.when(s.startswith("*"), F.concat(F.lit("%2A"), F.substr(s, F.lit(2)))).when(s.startswith("~"), F.concat(F.lit("%7E"), F.substr(s, F.lit(2)))).otherwise(s)
    return F.transform(cut, lambda s: F.when(digits(s), F.concat(F.lit("#"), F.regexp_extract(s, r"\.[a-z]{1,5}$", 0))).otherwise(literal(s)))


SUMS = ("n", "bad", "labelled")


def sums(prefix: str = "") -> list[Column]:
    return [F.sum(c).alias(prefix + c) for c in SUMS]


def shared(low: Column, high: Column) -> Column:
    """How many leading segments the smallest and the largest of some paths share, and so all of them do."""
    apart = F.array_position(F.zip_with(low, high, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return F.when(apart > 0, apart - 1).otherwise(F.size(low)).cast("int")


def groups(children: Column) -> Column:
    """(own, name) of each child of a node, from at most MOST structs (purity, labelled, bad, own) in order."""
    none = F.array().cast("array<struct<own:string,group:int>>")
    start = F.struct(none.alias("done"), F.lit(0).alias("group"), F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("labelled"))

    def step(held: Column, child: Column) -> Column:
        bad, labelled = held["bad"] + child["bad"], held["labelled"] + child["labelled"]
        p = F.try_divide(bad, labelled)
        apart = F.try_divide(F.abs(child["purity"] - F.try_divide(held["bad"], held["labelled"])), F.sqrt(F.try_divide(p * (1 - p), held["labelled"]) + F.try_divide(p * (1 - p), child["labelled"])))
        joins = (held["labelled"] > 0) & F.coalesce(apart < ALIKE, F.lit(True))
        group = F.when(joins, held["group"]).otherwise(held["group"] + 1)
        placed = F.array_append(held["done"], F.struct(child["own"].alias("own"), group.alias("group")))
        return F.struct(placed.alias("done"), group.alias("group"), F.when(joins, bad).otherwise(child["bad"]).alias("bad"), F.when(joins, labelled).otherwise(child["labelled"]).alias("labelled"))

    walked = F.aggregate(F.filter(children, lambda c: c["labelled"] > 0), start, step)["done"]

    def named(placed: Column) -> Column:
        alone = lambda c: F.size(F.filter(placed, lambda o: o["group"] == c["group"])) == 1
        return F.transform(placed, lambda c: F.struct(c["own"].alias("own"), F.when(alone(c), c["own"]).otherwise(F.concat(F.lit("~"), c["group"].cast("string"))).alias("name")))

    unknown = F.filter(children, lambda c: c["labelled"] == 0)
    rest = F.transform(unknown, lambda c: F.struct(c["own"].alias("own"), F.when(F.size(unknown) == 1, c["own"]).otherwise("~").alias("name")))
    return F.concat(F.transform(F.array(walked), named)[0], rest)


def grow(urls: DataFrame) -> DataFrame:
    """urls with host, path (a digest), s (segments), bad, labelled (0 or 1) -> (host, path, n, bad, labelled, t): one row per path, with its template."""
    # One row per host and segment path: every level works on these counts. A node is known by a digest of fixed size.
    counted = urls.groupBy("host", "path").agg(F.any_value("s").alias("rest"), F.count("*").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    left = materialise(counted.withColumn("node", F.col("host")).withColumn("t", F.lit("")), "paths")
    kept = ["host", "path", *SUMS, "t"]
    folder, before = new_path(urls.sparkSession, "finished"), [left]
    finished = left.select(*kept).schema
    while paths := left.count():
        node = left.groupBy("node").agg(F.count("*").alias("weight"), *sums("all_"), shared(F.min("rest"), F.max("rest")).alias("same"))
        split = (F.col("all_bad") > 0) & (F.col("all_bad") < F.col("all_labelled")) & (F.col("all_labelled") >= ALIKE**2)
        met = join_hot(left, node.select("node", "weight", "same", split.alias("split")), ["node"], "weight", paths)
        own = lambda: F.slice("rest", 1, F.col("same"))
        t = F.when(F.col("same") > 0, F.concat("t", F.lit("/"), F.array_join(own(), "/"))).otherwise(F.col("t"))
        met = met.withColumn("t", t).withColumn("rest", F.slice("rest", F.col("same") + 1, F.size("rest"))).drop("same")
        at = materialise(met, "level")
        done = at.filter((F.size("rest") == 0) | ~F.col("split")).withColumn("t", F.when(F.size("rest") == 0, F.col("t")).otherwise(F.concat("t", F.lit("/**"))))
        done.select(*kept).write.mode("append").parquet(folder)
        open_ = at.filter((F.size("rest") > 0) & F.col("split")).drop("split").withColumn("own", F.col("rest")[0])
        branch = materialise(open_.groupBy("node", "own").agg(F.count("*").alias("rows"), *sums()), "branches", instead_of=before)
        kinds = branch.groupBy("node").agg(F.count("*").alias("weight"), F.sum("n").alias("all_n"))
        kinds = kinds.withColumn("variable", (F.col("weight") > MOST) | ((F.col("weight") > VARIABLE) & (F.col("all_n") < HELD * F.col("weight"))))
        held = join_hot(branch, kinds.select("node", "weight", "variable"), ["node"], "weight", paths)
        child = F.struct(F.coalesce(F.try_divide("bad", "labelled"), F.lit(-1.0)).alias("purity"), "labelled", "bad", "own")
        few = held.filter(~F.col("variable")).groupBy("node").agg(F.sort_array(F.collect_list(child)).alias("children")).select("node", F.inline(groups(F.col("children"))))
        named = branch.join(few, ["node", "own"], "left").select("node", "own", F.coalesce("name", F.lit("*")).alias("name"), F.col("rows").alias("weight"))
        grown = join_hot(open_, named, ["node", "own"], "weight", paths)
        left = materialise(grown.select("host", "path", F.slice("rest", 2, F.size("rest")).alias("rest"), *SUMS, F.md5(F.concat("node", F.lit("/"), "name")).alias("node"), F.concat("t", F.lit("/"), "name").alias("t")), "paths")
        before = [at, branch, left]
    return urls.sparkSession.read.schema(finished).parquet(folder) if len(before) > 1 else left.select(*kept)


def judge(urls: DataFrame) -> DataFrame:
    """(path, n, template, purity, learned): one row per host and segment path."""
    nodes = materialise(grow(urls), "grown")
    by_template = materialise(nodes.groupBy("host", "t").agg(F.count("*").alias("weight"), *sums()), "templates")
    by_host = by_template.groupBy("host").agg(F.count("*").alias("templates"), F.sum("bad").alias("host_bad"), F.sum("labelled").alias("host_labelled"))
    paths, bad, labelled = by_template.agg(F.sum("weight"), F.sum("bad"), F.sum("labelled")).first()
    everywhere = bad / labelled if labelled else 0.0
    host = (F.col("host_bad") + STRENGTH * everywhere) / (F.col("host_labelled") + STRENGTH)
    purity = (F.col("bad") + STRENGTH * host) / (F.col("labelled") + STRENGTH)
    judged = join_hot(by_template, by_host, ["host"], "templates", paths or 0).select("host", "t", "weight", purity.alias("purity"))
    found = join_hot(nodes.select("host", "path", "n", "t"), judged, ["host", "t"], "weight", paths or 0)
    return found.select("path", "n", F.col("t").alias("template"), "purity", F.when(F.col("purity") > REJECT, "block").otherwise("allow").alias("learned"))


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of every url; the rules' verdicts are the tree's labels."""
    host, path = host_and_path(F.col(url).cast("string"))
    rows = df.select(F.col(key).alias("key"), host.alias("name"), path.alias("way"))
    rows = rows.withColumn("rule", rule_for(F.col("name"), F.col("way"), rules)).withColumn("s", segments(F.col("way")))
    host, verdict = F.md5(F.col("name")), F.col("rule")["verdict"]
    rows = rows.withColumn("host", host).withColumn("path", F.md5(F.concat(host, F.lit("/"), F.array_join("s", "/"))))
    marked = rows.select("host", "path", "s", F.col("rule").isNotNull().cast("long").alias("labelled"), F.coalesce((verdict == "block").cast("long"), F.lit(0).cast("long")).alias("bad"))
    judged = materialise(judge(marked), "judged")
    total = judged.agg(F.sum("n")).first()[0] or 0
    found = join_hot(rows, judged, ["path"], "n", total)
    return found.select(F.col("key").alias(key), F.col("name").alias("host"), F.col("way").alias("path"), F.col("rule")["rule"].alias("rule"), F.coalesce(verdict, "learned").alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))

"""URL filters: a tree of path templates for every host.

Segments of a path that are numbers or identifiers become wildcards at once. Then, level by level and over counts of
patterns only, the children of each place are merged into branches: where segments seen once hold a large share of the
urls (the estimated chance that the next one is new), the place is variable and its children are a wildcard; elsewhere
children go together whose distributions of what lies below don't differ significantly from their parent's (chi-square);
and in both cases those whose share of labels lies significantly above or below their parent's stay apart from the rest.
A child with few labels or none shares its siblings' branch and labels only as far as chance may have left it without: one that
has significantly fewer labels for its urls than its parent was not left out by chance, so its siblings' labels say nothing
about it, and it starts from the prior. A template is rejected if its purity
reaches a threshold: the share of its labelled urls that are to be blocked, smoothed towards that of the place above it,
and so on up to the host, whose own is smoothed towards a prior, as is that of a branch unlike its siblings. Rules of hosts and path prefixes come first.

Defined results: a null url, or one without "://", has an empty host and path, and is judged like any other template;
labels other than 0 and 1 count as none; repeated urls count each time; paths of any depth keep all segments, and segments
of any length are compared whole; a branch of more than max_names is shown as a wildcard, which is its name only; of rules of equal length that fit the last in order of text wins; of merged names the
order is that of text; an empty table gives an empty result; other columns are kept, and a clash of names with the new
ones is avoided by leading underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import setting
from .util import column_name, discard, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks branches that have significantly fewer labels than their siblings.
UNLABELLED = "?"
#: The rules of the query.
RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and what it says; null if none fits."""
    rule, says = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        name, prefix = r.split("/", 1)
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, says = F.when(fits, r).otherwise(rule), F.when(fits, action).otherwise(says)
    return rule, says


def pattern_of(path: Column) -> Column:
    """Segments with numbers and identifiers as wildcards; what follows a segment's last dot stays."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    number, identifier = r"^\d+(?=\.[A-Za-z]{1,5}$|$)", (
        r"^(?=[^.]*\d)[0-9A-Fa-f]{8,}(?=\.[A-Za-z]{1,5}$|$)|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
    )
    return F.transform(parts, lambda x: F.regexp_replace(F.regexp_replace(x, number, "{n}"), identifier, "{x}"))


def _share(n1: Column, n0: Column) -> Column:
    return (n1 + 0.5) / (n1 + n0 + 1)


def _deviates(n1: Column, n0: Column, share: Column, z: float) -> Column:
    """'+' or '-' if n1 of n1 + n0 lies significantly above or below the share, else ''. No labels never deviate."""
    n = n1 + n0
    off = (n1 - n * share) / F.sqrt(F.greatest(n, F.lit(1)) * share * (1 - share))
    return F.when(off > z, "+").when(off < -z, "-").otherwise("")


def _unlike(chi: Column, freedom: Column, z: float) -> Column:
    """Whether a chi-square sum is significant, by the cube-root normal approximation."""
    k = 2.0 / (9 * F.greatest(freedom, F.lit(1)))
    return (freedom > 0) & ((F.pow(chi / F.greatest(freedom, F.lit(1)), F.lit(1 / 3)) - (1 - k)) / F.sqrt(k) > z)


def templates(patterns: DataFrame, prior: float = 0.25, strength: float = 4.0, unseen: float = 0.2, max_names: int = 16, z: float = 1.96) -> DataFrame:
    """(host, pattern, n, n1, n0) to (host, pattern, template, purity). Every level is a handful of small plans of its own, for
    which compiled stages would fill the driver's memory with classes: they are interpreted."""
    with setting(patterns.sparkSession, "spark.sql.codegen.wholeStage", "false"):
        return _templates(patterns, prior, strength, unseen, max_names, z)


def _templates(patterns: DataFrame, prior: float, strength: float, unseen: float, max_names: int, z: float) -> DataFrame:
    hosts = patterns.groupBy("host").agg(F.sum("n1").alias("p1"), F.sum("n0").alias("p0"))
    hosts = hosts.select("host", "p1", "p0", ((F.col("p1") + strength * prior) / (F.col("p1") + F.col("p0") + strength)).alias("purity"))
    rows = patterns.join(hosts, "host").select(
        "host", "pattern", "n", "n1", "n0", "p1", "p0", "purity", F.slice("pattern", 1, 0).alias("done"), F.col("pattern").alias("rest")
    )
    rows = stash(rows)
    while rows.agg(F.max(F.size("rest"))).first()[0]:
        rows = _descended(rows)
        names = stash(_branches(rows, unseen, max_names, z))
        at, more = F.when(F.size("rest") > 0, F.element_at("rest", 1)), F.col("name").isNotNull()
        moved = rows.withColumn("seg", at).join(names, ["host", "done", "seg"], "left")
        new = stash(
            moved.select(
                "host", "pattern", "n", "n1", "n0", "p1", "p0", F.when(F.col("alone"), F.lit(prior)).otherwise(F.col("purity")).alias("purity"),
                F.coalesce("alone", F.lit(False)).alias("alone"), more.alias("moved"),
                F.when(more, F.concat("done", F.array("name"))).otherwise(F.col("done")).alias("done"),
                F.when(more, F.expr("slice(rest, 2, size(rest))")).otherwise(F.col("rest")).alias("rest"),
            )
        )
        discard(rows)
        discard(names)
        rows = _smoothed(new, strength)
    return rows.select("host", "pattern", F.concat(F.lit("/"), F.array_join("done", "/")).alias("template"), "purity")


def _branches(rows: DataFrame, unseen: float, max_names: int, z: float) -> DataFrame:
    """(host, done, seg, name, alone): the branch that each child of a place goes to, and whether it is so unlike its
    siblings that their labels say nothing about it."""
    here = rows.where(F.size("rest") > 0).select(
        "host", "done", F.element_at("rest", 1).alias("seg"), F.expr("slice(rest, 2, size(rest))").alias("below"), "n", "n1", "n0"
    )
    counts = [F.sum(c).alias(c) for c in ("n", "n1", "n0")]
    inner = here.groupBy("host", "done", "seg", "below").agg(*counts)
    kids = inner.groupBy("host", "done", "seg").agg(*counts, F.expr("bit_xor(xxhash64(below))").alias("shape"))
    parents = kids.groupBy("host", "done").agg(
        F.count("*").alias("kids"), F.sum("n").alias("total"), F.sum("n1").alias("a1"), F.sum("n0").alias("a0"), F.count(F.when(F.col("n") == 1, 1)).alias("once")
    )
    # what lies below a child, against what lies below all children of its parent
    below = inner.groupBy("host", "done", "below").agg(F.sum("n").alias("all"))
    kinds = below.groupBy("host", "done").agg(F.count("*").alias("kinds"))
    expected = F.col("m") * F.col("all") / F.col("total")
    seen = inner.select("host", "done", "seg", "below", "n").join(below, ["host", "done", "below"])
    seen = seen.join(kids.select("host", "done", "seg", F.col("n").alias("m")), ["host", "done", "seg"]).join(parents.select("host", "done", "total"), ["host", "done"])
    # the kinds that a child lacks add what is expected of them: m less the expected of those it has
    chi = F.sum(F.pow(F.col("n") - expected, 2) / expected - expected) + F.first("m")
    chi = seen.groupBy("host", "done", "seg").agg(chi.alias("chi"))
    judged = kids.join(parents.join(kinds, ["host", "done"]), ["host", "done"]).join(chi, ["host", "done", "seg"])
    variable = (F.col("kids") > 2) & (F.col("once") >= unseen * F.col("total"))
    label = _deviates(F.col("n1"), F.col("n0"), _share(F.col("a1"), F.col("a0")), z)
    labelled, of_all = F.col("n1") + F.col("n0"), F.col("a1") + F.col("a0")
    passed = F.when(_deviates(labelled, F.col("n") - labelled, _share(of_all, F.col("total") - of_all), z) == "-", UNLABELLED).otherwise("")
    label = F.concat(label, passed)
    own = F.when(_unlike(F.col("chi"), F.col("kinds") - 1, z), F.col("shape").cast("string")).otherwise("")
    judged = judged.select("host", "done", "seg", label.alias("label"), F.when(variable, "*").otherwise(own).alias("kind"))
    branch = judged.groupBy("host", "done", "kind", "label").agg(F.count("*").alias("size"))
    alone = ~F.col("kind").isin("*", "") | F.col("label").endswith(UNLABELLED)
    # few names are listed; many, and those of a variable place, are a wildcard
    named = judged.join(branch, ["host", "done", "kind", "label"]).withColumn("wild", (F.col("kind") == "*") & (F.col("size") > 1) | (F.col("size") > max_names))
    lists = named.where(~F.col("wild")).groupBy("host", "done", "kind", "label").agg(F.sort_array(F.collect_set("seg")).alias("segs"))
    joined = F.when(F.size("segs") > 1, F.concat(F.lit("("), F.array_join("segs", "|"), F.lit(")"))).otherwise(F.col("segs")[0])
    lists = lists.select("host", "done", F.explode("segs").alias("seg"), joined.alias("name"), alone.alias("alone"))
    shown = F.when(F.col("kind").isin("*", ""), "").otherwise(F.col("kind"))
    wild = named.where("wild").select("host", "done", "seg", F.concat(F.lit("*"), "label", shown).alias("name"), alone.alias("alone"))
    return lists.unionByName(wild)


def _smoothed(rows: DataFrame, strength: float) -> DataFrame:
    """rows with the purity of the place that they have come to: its own labels, smoothed towards its parent's purity.
    A place with all its parent's labels adds nothing to them, one unlike its siblings starts from the prior; rows that
    have ended above stay as they are."""
    own = rows.where("moved").groupBy("host", "done").agg(F.sum("n1").alias("q1"), F.sum("n0").alias("q0"))
    joined = rows.join(own, ["host", "done"], "left")
    new = F.col("moved") & ((F.col("q1") + F.col("q0")) < (F.col("p1") + F.col("p0")))
    purity = F.when(F.col("alone") | new, (F.col("q1") + strength * F.col("purity")) / (F.col("q1") + F.col("q0") + strength)).otherwise(F.col("purity"))
    out = stash(joined.select("host", "pattern", "n", "n1", "n0", F.coalesce("q1", "p1").alias("p1"), F.coalesce("q0", "p0").alias("p0"), purity.alias("purity"), "done", "rest"))
    discard(rows)
    return out


def _descended(rows: DataFrame) -> DataFrame:
    """rows moved down to the next place with different children: only children stand for themselves, so there are no more
    rounds than branchings, however deep the paths."""
    spans = rows.where(F.size("rest") > 0).groupBy("host", "done").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    differ = F.array_position(F.transform(F.arrays_zip("low", "high"), lambda x: x["low"].eqNullSafe(x["high"])), F.lit(False))
    spans = spans.select("host", "done", F.when(differ > 0, differ - 1).otherwise(F.size("low")).cast("int").alias("same"))
    moved = rows.join(spans, ["host", "done"], "left").withColumn("same", F.when(F.size("rest") > 0, F.col("same")).otherwise(0))
    down = F.expr("concat(done, slice(rest, 1, same))").alias("done"), F.expr("slice(rest, same + 1, size(rest))").alias("rest")
    new = stash(moved.select("host", "pattern", "n", "n1", "n0", "p1", "p0", "purity", *down))
    discard(rows)
    return new


def judge(
    pages: DataFrame, rules: list[tuple[str, str]] = RULES, url_col: str = "url", label_col: str | None = None, threshold: float = 0.5, **tree
) -> DataFrame:
    """pages with host, path, rule, verdict, template and purity behind the others. label_col: 1 to block, 0 to allow;
    without it the rules' own verdicts are the labels, and say what the rest of a host is like."""
    added = ("host", "path", "rule", "verdict", "template", "purity")
    names = {c: column_name(pages, c) for c in (*added, "_says", "_label", "_pattern", "_found_host", "_found_pattern")}
    col = lambda c: F.col(names[c])
    url = F.col(f"`{url_col}`").cast("string")
    rows = pages.withColumn(names["host"], host_of(url)).withColumn(names["path"], path_of(url))
    rule, says = rule_of(col("host"), col("path"), rules)
    rows = rows.withColumn(names["rule"], rule).withColumn(names["_says"], says).withColumn(names["_pattern"], pattern_of(col("path")))
    ruled = F.when(col("_says") == "block", 1).when(col("_says") == "allow", 0)
    rows = rows.withColumn(names["_label"], F.col(f"`{label_col}`").cast("int") if label_col else ruled)
    labelled = lambda y: F.count(F.when(col("_label") == y, 1))
    counted = rows.groupBy(col("host").alias("host"), col("_pattern").alias("pattern")).agg(F.count("*").alias("n"), labelled(1).alias("n1"), labelled(0).alias("n0"))
    found = templates(counted, **tree).toDF(*(names[c] for c in ("_found_host", "_found_pattern", "template", "purity")))
    joined = rows.join(found, (col("host") == col("_found_host")) & (col("_pattern") == col("_found_pattern")))
    verdict = F.coalesce(col("_says"), F.when(col("purity") >= threshold, "block").otherwise("allow"))
    joined = joined.withColumn(names["verdict"], verdict)
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], *[names[c] for c in added])


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages).drop("url")

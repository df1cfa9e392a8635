"""URL filters whose entries come and go.

A list is a log of dated changes: on a day a pattern was added to a list or removed from it. Changes
become validity intervals, and every capture is judged by the entries active when it was fetched. A
pattern is a host, which also covers its subdomains, or a host and leading path segments. A capture
looks its patterns up in an equi-join on pattern and time bucket, so that a pattern with a long
history is not compared as a whole and Spark can split a host that holds a large share of captures.
Only DataFrame expressions are used.

Nulls: a null or malformed url has no host and matches nothing, nor does a capture without a time;
list changes without list, pattern, time or action are void. Repeated captures give repeated rows,
repeated changes count once, and of changes at one moment the removal holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshlight.llm.batches import without

BUCKET_SECONDS = 90 * 86_400
RESULT = ("n_active", "lists", "pattern", "blocked")


def host_of(url: Column) -> Column:
    """The host in lower case, without user, port and closing dot; empty if there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(found, r"\.$", "")


def path_of(url: Column) -> Column:
    """The non-empty path segments."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: s != "")


def patterns_of(url: Column, depth: int, labels: int) -> Column:
    """Every pattern that covers the url and has at most ``depth`` segments and ``labels`` host labels."""
    parts = F.split(host_of(url), r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - labels + 1)
    domains = F.transform(
        F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    segments = path_of(url)
    deepest = F.least(F.size(segments), F.lit(depth))
    paths = F.when(deepest >= 1, F.transform(
        F.sequence(F.lit(1), deepest), lambda i: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(segments, 1, i), "/"))
    )).otherwise(F.array().cast("array<string>"))
    return F.when(host_of(url) != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def intervals(changes: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from changes (list, kind, pattern, at, action).

    ``at`` is in seconds; ``action`` is add or remove; ``until`` is null while an entry lasts.
    """
    valid = changes.where(
        "list IS NOT NULL AND kind IS NOT NULL AND pattern IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')"
    ).select("list", "kind", "pattern", F.col("at").cast("bigint").alias("since"), "action").distinct()
    order = Window.partitionBy("list", "kind", "pattern").orderBy("since", "action")
    following = valid.withColumn("until", F.lead("since").over(order))
    return following.where("action = 'add' AND (until IS NULL OR until > since)").drop("action")


def filtered(
    captures: DataFrame, changes: DataFrame, url: str = "url", at: str = "fetched", bucket_seconds: int = BUCKET_SECONDS
) -> DataFrame:
    """Add ``n_active`` (covering entries active at the fetch), ``lists`` (their sorted names), the
    deciding ``pattern`` and ``blocked``.

    The longest active pattern decides; where a block and an allow entry are equally long, allow does.
    """
    names = without(captures, RESULT)
    span = captures.agg(F.min(F.col(f"`{at}`").cast("bigint")), F.max(F.col(f"`{at}`").cast("bigint"))).first()
    entries = intervals(changes)
    shape = entries.agg(
        F.max(F.size(F.split("pattern", "/"))) , F.max(F.size(F.split(F.substring_index("pattern", "/", 1), r"\.")))
    ).first()
    depth, labels = (shape[0] or 1) - 1, shape[1] or 0
    low, high = span if span[0] is not None else (0, 0)
    bucket = lambda seconds: F.floor(seconds / F.lit(bucket_seconds))
    live = entries.where((F.col("since") <= high) & (F.col("until").isNull() | (F.col("until") > low)))
    last = F.least(F.lit(high), F.coalesce(F.col("until") - 1, F.lit(high)))
    dated = live.withColumn("bucket", F.explode(F.sequence(bucket(F.greatest(F.lit(low), "since")), bucket(last)))).select(
        "list", "kind", F.col("pattern").alias("_pattern"), "since", "until", F.col("bucket").alias("_bucket")
    )
    fetched = F.col(f"`{at}`").cast("bigint")
    # Equal captures are judged once; their rows get the verdict back by the same two columns.
    asked = captures.select(F.col(f"`{url}`").alias("_url"), fetched.alias("_at")).where("_url IS NOT NULL AND _at IS NOT NULL").distinct()
    keyed = asked.withColumn("pattern", F.explode(patterns_of(F.col("_url"), depth, labels))).withColumn("bucket", bucket(F.col("_at")))
    active = keyed.join(
        dated,
        (F.col("pattern") == F.col("_pattern")) & (F.col("bucket") == F.col("_bucket"))
        & (F.col("since") <= F.col("_at")) & (F.col("until").isNull() | (F.col("until") > F.col("_at"))),
    )
    strength = F.struct(F.length("pattern").alias("length"), (F.col("kind") == "allow").alias("allow"), "pattern")
    verdicts = active.groupBy("_url", "_at").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"),
        F.max(strength).alias("_top"),
    )
    rows = captures.select(*[f"`{c}`" for c in names])
    return rows.join(
        verdicts, (F.col(f"`{url}`") == F.col("_url")) & (fetched == F.col("_at")), "left"
    ).select(
        *[rows[f"`{c}`"] for c in names],
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        F.col("_top.pattern").alias("pattern"),
        F.coalesce(~F.col("_top.allow"), F.lit(False)).alias("blocked"),
    )

"""URL filters by a temporal list join.

A list holds dated entries: at ``at`` an ``action`` (add or remove) for a ``kind`` of key
(host: the host and all below it; prefix: a host with a path and all below it) in a
``verdict`` (block or allow). Entries of a key become validity intervals: from an add to
the next entry of the same key and verdict. Every capture is judged by the intervals that
hold when it was fetched: at ``fetched_at``, from included, until excluded.

A capture has one key for each level of its host and each level of its path; hosts have no
case, paths do, and an IPv4 address is one level. The as-of join sorts entries and captures
of a key together by time, and the last entry of each verdict before a capture tells
whether it is listed: one pass, however many dated entries a key has. Captures carry a salt
and entries are repeated for each, so a host that holds a third of all captures is
dealt to ``SALTS`` tasks; captures of one key at one time are judged once. The most
specific key decides, allow before block among equal ones.

Defined cases: a null, empty or hostless URL has no key and is ``unlisted``; a null fetch
time too; a null date, key, kind, action or verdict of a list entry is ignored; an add to
a key that is listed already starts a new interval where the old one ends; entries of
equal time count as remove, then add; repeated rows are judged each on its own; empty
tables give no intervals or an empty result; other columns pass through, and input
columns named like result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
RESULT = ("host", "verdict", "listed_key", "listed_from", "n_active")


def host_of(url: Column) -> Column:
    """Host in lower case without user, port and final dot; null where there is none."""
    authority = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":[0-9]*$", ""))
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path without query, fragment, and empty steps; '' for the root."""
    path = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "/$", "")


def keys_of(url: Column) -> Column:
    """array of (key, depth): host levels from the top-level label on, then path levels of the host."""
    host, path = host_of(url), path_of(url)
    labels = F.when(host.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.array(host)).otherwise(F.split(host, r"\."))
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.array_join(F.slice(labels, n - i + 1, i), ".").alias("key"), i.alias("depth")))
    paths = F.when(F.size(steps) >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda i: F.struct(
        F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("key"),
        (n + i).alias("depth"))))
    none = F.array().cast("array<struct<key:string,depth:int>>")
    return F.when(host.isNotNull(), F.concat(hosts, F.coalesce(paths, none))).otherwise(none)


def _entries(entries: DataFrame) -> DataFrame:
    """(key, verdict, action, at) of the list entries that count, each once."""
    key = F.concat(F.lower(F.substring_index("key", "/", 1)), F.regexp_extract("key", "/.*$", 0))
    return entries.where("key is not null and at is not null and action in ('add', 'remove') "
                         "and verdict in ('block', 'allow')") \
        .select(key.alias("key"), "verdict", "action", "at").distinct()


def intervals(entries: DataFrame) -> DataFrame:
    """(key, verdict, valid_from, valid_to) of a list; valid_to is null while an entry holds."""
    order = Window.partitionBy("key", "verdict").orderBy("at", F.desc("action"))
    return (_entries(entries).withColumn("valid_to", F.lead("at").over(order)).where("action = 'add'")
            .where("valid_to is null or valid_to > at")
            .select("key", "verdict", F.col("at").alias("valid_from"), "valid_to"))


def _as_of(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of keys (key, salt, __at, ...) with verdict and valid_from of every listing of the key that
    holds at __at: the last entry of a verdict up to then, if it is an add."""
    listed = _entries(entries)
    # of one time: removals, then adds, then captures
    events = listed.select(
        "key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("at").cast("timestamp").alias("__time"),
        F.when(F.col("action") == "add", 1).otherwise(0).alias("__turn"),
        *(F.when(F.col("verdict") == v, F.struct(F.when(F.col("action") == "add", F.col("at")).alias("valid_from"))).alias(v)
          for v in ("block", "allow")))
    both = events.unionByName(keys.withColumns({"__time": F.col("__at").cast("timestamp"), "__turn": F.lit(2)}),
                              allowMissingColumns=True)
    before = Window.partitionBy("key", "salt").orderBy("__time", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    state = both.withColumns({v: F.last(v, ignorenulls=True).over(before) for v in ("block", "allow")}).where("__turn = 2")
    listings = F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v)["valid_from"].alias("valid_from")) for v in ("block", "allow")))
    held = state.withColumn("l", F.explode(F.filter(listings, lambda x: x["valid_from"].isNotNull())))
    return held.select(*keys.columns, "l.verdict", "l.valid_from")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched_at: str = "fetched_at") -> DataFrame:
    """Input columns plus host, verdict (block, allow or unlisted), listed_key and listed_from (of the
    deciding entry) and n_active (intervals that held)."""
    keep = [c for c in captures.columns if c not in (*RESULT, "__path", "__at")]
    seen = captures.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("__path"),
                           F.col(fetched_at).alias("__at"))
    # each address at each time once
    asked = seen.where("host is not null and __at is not null").select("host", "__path", "__at").distinct()
    keys = (asked.select("host", "__path", "__at", F.explode(keys_of(F.concat(F.lit("//"), "host", "__path"))).alias("k"))
            .select("host", "__path", "__at", "k.key", "k.depth",
                    F.pmod(F.xxhash64("host", "__path", "__at"), F.lit(SALTS)).cast("int").alias("salt")))
    active = _as_of(keys, entries)
    best = F.struct("depth", (F.col("verdict") == "allow").alias("allowed"), "valid_from", "key", "verdict")
    judged = active.groupBy("host", "__path", "__at").agg(F.max(best).alias("best"), F.count("*").alias("n_active"))
    return (seen.join(judged, ["host", "__path", "__at"], "left")
            .select(*keep, "host", F.coalesce("best.verdict", F.lit("unlisted")).alias("verdict"),
                    F.col("best.key").alias("listed_key"), F.col("best.valid_from").alias("listed_from"),
                    F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active")))

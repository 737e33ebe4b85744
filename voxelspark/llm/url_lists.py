"""URL filter by dated lists: entries become validity intervals, and an as-of join judges each capture at its fetch time.

DataFrame functions only. A capture is looked up under every domain suffix of its host (two labels or more), alone and with
each leading part of its path, as many as the longest path of an entry has segments; the longest entry active at fetch time
decides. The captures of one host can be a third of all: their rows are salted, and each interval is repeated once for each salt, so the join has no hot key.

Nulls: a null or unusable URL (no scheme and host, or a host over 253 characters) matches nothing; a null fetch time
matches nothing. A dot at the end of a host does not count. Entries with a null pattern, action or date, or with an action other than add and
remove (in any case), are skipped. Several entries for one pattern and day: an add
wins over a remove. Captures alike in id, URL and time come out as one row, with their number in `copies`. An empty list
blocks nothing; no captures give no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
SEGMENT = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)"
PATH = r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, '' where there is none."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    return F.when((F.length(host) > 253) | host.isNull(), "").otherwise(host)


def keys_of(url: Column, depth: int) -> Column:
    """The patterns that a URL can match: its host and every parent domain of two labels or more, alone and with each leading part of its path of up to `depth` segments."""
    host = F.rtrim(host_of(url), F.lit("."))
    segments = F.slice(F.filter(F.split(F.regexp_extract(F.lower(url), PATH, 1), "/"), lambda s: s != ""), 1, depth)
    parts = F.split(host, r"\.")
    # a host of one label has no suffix but itself
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    paths = F.transform(F.sequence(F.lit(0), F.size(segments)), lambda n: F.array_join(F.concat(F.array(F.lit("")), F.slice(segments, 1, n)), "/"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda d: F.transform(paths, lambda p: F.concat(d, p)))))


def plain(pattern: Column) -> Column:
    """A pattern in lower case, without slashes at its end or dots at the end of its host."""
    parts = F.split(F.lower(F.rtrim(pattern, F.lit("/"))), "/")
    return F.array_join(F.concat(F.array(F.rtrim(parts[0], F.lit("."))), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def deepest(entries: DataFrame, pattern: str = "pattern") -> int:
    """The most path segments of an entry."""
    return entries.agg(F.max(F.size(F.split(plain(F.col(pattern)), "/")) - 1)).first()[0] or 0


def validity(entries: DataFrame, *, pattern: str = "pattern", action: str = "action", at: str = "at") -> DataFrame:
    """pattern, valid_from, valid_to (null: still active): one row for each time that a pattern was listed."""
    known = entries.select(plain(F.col(pattern)).alias("pattern"), F.lower(F.trim(action)).alias("action"), F.col(at).alias("at")).dropna().where("action in ('add', 'remove')")
    by_day = known.groupBy("pattern", "at").agg(F.min("action").alias("action"))
    order = Window.partitionBy("pattern").orderBy("at")
    changes = by_day.withColumn("was", F.lag("action").over(order)).where((F.col("was").isNull() & (F.col("action") == "add")) | (F.col("was") != F.col("action")))
    spans = changes.withColumn("valid_to", F.lead("at").over(order))
    return spans.where(F.col("action") == "add").select("pattern", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, *, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched", salts: int = 16) -> DataFrame:
    """id, url, fetched, host, blocked, pattern, listed_since, copies for each capture."""
    own = captures.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(at_col).alias("fetched"))
    found = own.select("*", F.posexplode_outer(keys_of(F.col("url"), deepest(entries))).alias("k", "pattern"))
    found = found.withColumn("salt", F.pmod(F.xxhash64("id", "url", "fetched"), F.lit(salts)).cast("int"))
    spans = validity(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    in_force = (F.col("f.fetched") >= F.col("s.valid_from")) & (F.col("s.valid_to").isNull() | (F.col("f.fetched") < F.col("s.valid_to")))
    hits = found.alias("f").join(spans.alias("s"), (F.col("f.pattern") == F.col("s.pattern")) & (F.col("f.salt") == F.col("s.salt")) & in_force, "left")
    hit = F.when(F.col("s.pattern").isNotNull(), F.struct(F.length("s.pattern").alias("n"), F.col("s.pattern").alias("pattern"), F.col("s.valid_from").alias("since")))
    out = hits.groupBy("f.id", "f.url", "f.fetched").agg(F.max(hit).alias("hit"), F.sum(F.when(F.coalesce("f.k", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("fetched").alias(at_col), host_of(F.col("url")).alias("host"), F.col("hit").isNotNull().alias("blocked"), F.col("hit.pattern").alias("pattern"), F.col("hit.since").alias("listed_since"), "copies")

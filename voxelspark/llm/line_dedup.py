"""Line deduplication by winnowing: later copies of any run of lines with more than `words` words are deleted.

DataFrame functions only.

1. Lines with a word in them are hashed. At each line the shortest window that begins there and has more than `words` words,
   and the shortest one that ends there, select the place of their least line hash (the first of equal ones). Each selected
   place is one position; its fingerprint is that line's hash. Windows with equal lines select the same place in them, so
   every repeated run of that length has a position with the same fingerprint in each of its copies, whatever stands around.
2. Positions are joined by fingerprint: only those whose fingerprint is selected at another place go on.
3. Matches are extended both ways: a position carries the windows that selected it, as how far each reaches to the left and to
   the right and the hash of its lines with words. Positions agree on an extension where these are equal; all but the first (by doc_id,
   then place) are later copies. Overlapping ones are merged to maximal runs, which are deleted with the blank lines between.

A line goes if and only if it lies in a run of over `words` words that also begins at an earlier place.

A window has at most `words` + 1 lines. The first place of an extension is a minimum, so it is aggregated before the shuffle, and
no two copies are paired with each other: a passage in a third of the documents costs one row for each copy. Both joins deal
a fingerprint or extension that has more positions than a task's even share to as many tasks as it needs, and leave the others whole.

Nulls: a null text stays null. Rows alike in id and text are one document and come out alike. Null ids come first. Texts
without lines of words stay as they are; a document may lose all its lines and then has an empty text. Empty tables give
empty results. All columns of the input are kept, whatever their names; but
one named as the column that is added (`removed`) gives way to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.shared import drop_stored, salted_join, stored

WORD = r"[^\x20\x09-\x0D]+"


def positions(docs: DataFrame, *, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_hash, place, fingerprint, windows (array of first, last, content): the positions that windows of over `words` words select."""
    text = F.col(text_col)
    lines = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    lines = lines.select("doc", "text_hash", "pos", F.xxhash64("line").alias("h"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n")).where("n > 0")
    lines = lines.repartition("doc", "text_hash").dropDuplicates(["doc", "text_hash", "pos"])
    of = Window.partitionBy("doc", "text_hash")
    lines = lines.withColumn("end", F.sum("n").over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("n"))
    ahead, back = of.orderBy("begin").rangeBetween(0, words), of.orderBy("end").rangeBetween(-words, 0)
    window = lambda w, first, last: F.struct(first.alias("first"), last.alias("last"), F.sum("n").over(w).alias("total"), F.min(F.struct("h", "pos")).over(w).alias("least"), F.xxhash64(F.collect_list("h").over(w)).alias("content"))
    both = lines.withColumn("a", window(ahead, F.col("pos"), F.max("pos").over(ahead))).withColumn("b", window(back, F.min("pos").over(back), F.col("pos")))
    one = F.when(F.col("a.first") == F.col("b.first"), F.array("a")).otherwise(F.array("a", "b"))
    each = both.select("doc", "text_hash", F.explode(one).alias("w")).where(F.col("w.total") > words)
    return each.groupBy("doc", "text_hash", F.col("w.least.pos").alias("place"), F.col("w.least.h").alias("fingerprint")).agg(F.collect_set(F.struct("w.first", "w.last", "w.content")).alias("windows"))


def repeated_runs(docs: DataFrame, *, words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, text_hash, runs (array of first and last line, in order): the lines to delete of every document that has any."""
    selected = stored(positions(docs, words=words, id_col=id_col, text_col=text_col))
    of_copy = F.struct("doc", "text_hash", "place")
    shared = stored(selected.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1"))
    met = salted_join(selected, shared, ["fingerprint"], of_copy, "n", selected.count())
    met = stored(met.select("doc", "text_hash", "place", "fingerprint", F.explode("windows").alias("w")).select("doc", "text_hash", "place", "fingerprint", "w.*"))
    drop_stored(selected, shared)
    at = F.struct("doc", "text_hash", "first")
    extension = ["fingerprint", "content"]
    origins = stored(met.groupBy(*extension).agg(F.min(at).alias("origin"), F.count("*").alias("n")).where("n > 1"))
    later = salted_join(met, origins, extension, of_copy, "n", met.count()).where(at != F.col("origin")).select("doc", "text_hash", "first", "last")
    of = Window.partitionBy("doc", "text_hash").orderBy("first", "last")
    reach = F.max("last").over(of.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("new").over(of.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc", "text_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    found = stored(runs.groupBy("doc", "text_hash").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs")))
    drop_stored(met, origins)
    return found


def dedup_lines(docs: DataFrame, *, words: int = 50, id_col: str = "doc_id", text_col: str = "text", removed: str = "removed_lines") -> DataFrame:
    """docs with the later copies of repeated runs cut from their texts, and how many lines went in a column after the others."""
    runs = repeated_runs(docs, words=words, id_col=id_col, text_col=text_col)
    d, r = docs.alias("d"), runs.alias("r")
    both = d.join(r, F.col(f"d.`{id_col}`").eqNullSafe(F.col("r.doc")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("r.text_hash")), "left")
    kept = """array_join(flatten(transform(sequence(0, size(r.runs)), i -> slice(split(d.`{t}`, '\\n'),
        IF(i = 0, 0, get(r.runs, i - 1).last + 1) + 1,
        IF(i = size(r.runs), size(split(d.`{t}`, '\\n')), get(r.runs, i).first) - IF(i = 0, 0, get(r.runs, i - 1).last + 1)))), '\\n')""".replace("{t}", text_col)
    text = F.when(F.col("r.runs").isNull(), F.col(f"d.`{text_col}`")).otherwise(F.expr(kept))
    gone = F.coalesce(F.expr("aggregate(r.runs, 0, (s, x) -> s + x.last - x.first + 1)"), F.lit(0))
    return both.select(*(text.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns if c != removed), gone.alias(removed))

"""Operator 3, document fingerprints: a canonical exact digest, in SQL functions only.

The canonical text is NFKC, case-folded, NFKC again (the ICU functions that Spark
ships with, called by ``java_method``), with runs of white space as one space and
none at the ends. Two seeded xxhash64 give a wide bucket. Inside buckets of two
texts or more the canonical bytes are compared, as their least and greatest, an
aggregate with map-side combining. Only if those differ does the digest of such
a bucket get a suffix of sha-256, so that different texts never share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, with_neighbours


def _icu(name: str, text: Column) -> Column:
    kind, method = name.rsplit(".", 1)
    return F.java_method(F.lit(kind), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text; plain ASCII needs no more than lower case."""
    nfkc = lambda c: _icu("com.ibm.icu.text.Normalizer.compose", c)
    folded = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(nfkc(_icu("com.ibm.icu.lang.UCharacter.foldCase", nfkc(text))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    part = lambda *c: F.lpad(F.lower(F.hex(F.xxhash64(*c))), 16, "0")
    return F.concat(part(canon), part(F.lit("wide"), canon))


def _in_unlike(digests: DataFrame) -> DataFrame:
    """Buckets (wide) that hold different canonical texts: by their bytes, edited ones by their sha-256."""
    bytes_ = digests.where("shared").groupBy("wide").agg(F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    sha = digests.select("wide", "sha").unionByName(digests.select(F.col("ewide").alias("wide"), F.col("esha").alias("sha")))
    sha = sha.groupBy("wide").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
    return bytes_.where("lo <> hi").select("wide").union(sha.where("lo <> hi").select("wide")).distinct().withColumn("unlike", F.lit(True))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): fingerprints of its text and of its edited text.

    The edited text ends in the start of the next text by id (after the last id,
    the first). Null texts are empty. Null ids come first; texts under one id go by
    their hashes; repeated rows count once in this order. A lone document follows
    itself; no documents give no rows. near_* are 1 for equal fingerprints and 0
    otherwise: the digest is exact. Other columns are ignored, whatever their names.

    Two passes over the texts: the first keeps a bucket and a length of each, the
    second shuffles the texts once, and that one exchange serves both the join that
    takes the start of the next text and the join that puts it in place.
    """
    lowest = F.lit(-(1 << 63))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), lowest).alias("did"), F.xxhash64(text).alias("key"), text.alias("text"))
    light = rows.select("did", "key", F.char_length("text").cast("long").alias("n"), canonical(F.col("text")).alias("canon"))
    light = materialize(light.select("did", "key", "n", wide_hash(F.col("canon")).alias("wide")))
    once = light.distinct()
    shared = materialize(light.groupBy("wide").count().where("count > 1").select("wide", F.lit(True).alias("shared")))  # so that the join's sides are both exchanged for it, and a hot bucket can be split
    placed = materialize(with_neighbours(once, ["did", "key"], ["did", "key"]).join(shared, "wide", "left").select("did", "key", "n", F.coalesce("shared", F.lit(False)).alias("shared"), "_next"))
    repeats = light.count() > placed.count()
    first = placed.agg(F.min(F.struct("did", "key")).alias("f")).first()["f"]
    drop(light, shared)
    head = (F.lit(first["did"]), F.lit(first["key"])) if first is not None else (lowest, F.lit(0))
    follows = placed.select(F.col("did").alias("pd"), F.col("key").alias("pk"), F.col("n").alias("pn"), "shared", F.coalesce("_next.did", head[0]).alias("did"), F.coalesce("_next.key", head[1]).alias("key"))
    half = lambda n: F.floor(n / 2).cast("int")
    # doc_id goes through both joins, so that both read the same exchange of the texts
    starts = rows.join(follows, ["did", "key"]).select("pd", "pk", "shared", F.coalesce("doc_id", lowest).alias("nd"), F.col("key").alias("nk"), F.substring("text", F.lit(1), half(F.col("pn"))).alias("start"))
    starts = starts.dropDuplicates(["pd", "pk"]) if repeats else starts
    n = F.char_length("text")
    both = rows.join(starts, (rows["did"] == starts["pd"]) & (rows["key"] == starts["pk"])).select(rows["doc_id"], rows["did"], rows["key"], rows["text"], "shared", "nd", "nk", "start")
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half(n)), "start"))
    both = both.withColumn("canon", canonical(F.col("text"))).withColumn("ecanon", canonical(F.col("edited")))
    digests = materialize(both.select(
        "doc_id", "did", "key", "nd", "nk", "shared", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), wide_hash(F.col("canon")).alias("wide"), F.sha2("canon", 256).alias("sha"),
        wide_hash(F.col("ecanon")).alias("ewide"), F.sha2("ecanon", 256).alias("esha"), F.when(F.col("shared"), F.col("canon")).alias("canon"),
    ))
    unlike = materialize(_in_unlike(digests))
    marked = digests.join(unlike, "wide", "left").join(unlike.select(F.col("wide").alias("ewide"), F.col("unlike").alias("eunlike")), "ewide", "left")
    name = lambda p: F.when(F.col(p + "unlike"), F.concat(p + "wide", F.lit("-"), p + "sha")).otherwise(F.col(p + "wide"))
    marked = materialize(marked.select("doc_id", "did", "key", "nd", "nk", "n_chars", "edited_sha256", name("").alias("fingerprint"), name("e").alias("edited_fingerprint")))
    drop(placed, digests, unlike)
    nexts = marked.select(F.col("did").alias("nd"), F.col("key").alias("nk"), F.col("fingerprint").alias("next_fingerprint")).distinct()
    equal = lambda a, b: (F.col(a) == F.col(b)).cast("double")
    return marked.join(nexts, ["nd", "nk"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", equal("fingerprint", "edited_fingerprint").alias("near_edited"), equal("fingerprint", "next_fingerprint").alias("near_next")
    )

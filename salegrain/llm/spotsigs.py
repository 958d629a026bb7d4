"""SpotSigs document fingerprints with DataFrame functions only.

A spot is a common word directly followed by a content word; its signature is the hash of the common word and a chain
of content words from there on, common words between them left out. A fingerprint is the set of a text's signatures.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents_of, let

#: Common words of English, French, German and Spanish; fixed values.
ANCHORS = tuple(
    """
    a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the their
    they this to was were which with you
    au aux avec ce ces cette dans de des du elle elles en est et il ils la le les leur mais ne nous on ou par pas pour
    que qui sa se ses son sur un une vous
    als am auch auf aus bei das dem den der die ein eine einem einen einer er es für hat ich im ist mit nach nicht oder
    sich sie sind so und von war wie wir zu zum zur
    al como con del el ella ellos era esta este esto ha la las lo los más me mi muy no nos para pero por porque
    se sin sobre su sus también y
    """.split()
)


def signatures(text: Column, chain: int = 2) -> Column:
    """The sorted distinct signature hashes of a text.

    A text without a spot has the hash of its word sequence instead, a text of other characters only the hash of
    itself; null and empty texts have an empty set.
    """
    plain = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(plain, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")

    def spots(all_words: Column) -> Column:
        placed = F.transform(all_words, lambda w, i: F.struct(w.alias("w"), F.get(all_words, i - 1).alias("before")))
        content = F.filter(placed, lambda x: ~x.w.isin(*ANCHORS))

        def chains(found: Column) -> Column:
            def one(x: Column, j: Column) -> Column:
                follow = [F.get(found, j + k).w for k in range(1, chain)]
                whole = F.get(found, j + chain - 1).isNotNull() & x.before.isin(*ANCHORS)
                return F.when(whole, F.xxhash64(x.before, x.w, *follow))

            return F.filter(F.transform(found, one), lambda h: h.isNotNull())

        hashed = let(content, chains)
        return let(
            F.array_sort(F.array_distinct(hashed)),
            lambda s: F.when(F.size(s) > 0, s).when(F.size(all_words) > 0, F.array(F.xxhash64(F.array_join(all_words, " ")))),
        )

    return F.coalesce(
        let(words, spots), F.when(plain != "", F.array(F.xxhash64(plain, F.lit(1)))), F.array().cast("array<bigint>")
    )


def fingerprint(signs: Column) -> Column:
    """The set as text: hexadecimal hashes, comma-joined."""
    return F.array_join(F.transform(signs, lambda s: F.hex(s)), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets; 1 for two empty ones. Sets are only intersected where neither is empty."""
    sizes = F.size(a) + F.size(b)
    common = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b))).otherwise(0)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(common / (sizes - common))


#: What tells a row's place in the order of ids: null ids come first, just before the smallest long; equal ids go by the text's hash.
KEY = ("_id", "_real", "_th")


def keyed_documents(docs: DataFrame) -> DataFrame:
    """The columns of ``KEY``, and text, null as empty."""
    return documents_of(docs).select("_id", F.col("doc_id").isNotNull().alias("_real"), "_th", F.coalesce("text", F.lit("")).alias("text"))


def following_documents(docs: DataFrame) -> DataFrame:
    """``KEY``, half, and next_id, next_real, next_th: each distinct row's successor by ``KEY``, the last's being the first.

    Rows are range-partitioned; a successor is looked up within its partition, and only each partition's first row crosses over.
    ``half`` is how many code points the successor gives to the edited text at most.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    half = F.floor(F.length("text") / 2).cast("int").alias("half")
    keys = keyed_documents(docs).select(*KEY, half).distinct()
    ranged = Scratch(spark, "following").write(keys.repartitionByRange(parts, *KEY).withColumn("_part", F.spark_partition_id()), "ranged")
    key = F.struct(*KEY)
    firsts = ranged.groupBy("_part").agg(F.min(key).alias("first"))
    after, every = Window.orderBy("_part"), Window.partitionBy()
    firsts = firsts.select("_part", F.coalesce(F.lead("first").over(after), F.min("first").over(every)).alias("across"))
    inside = ranged.withColumn("within", F.lead(key).over(Window.partitionBy("_part").orderBy(*KEY)))
    joined = inside.join(firsts, "_part").select(*KEY, "half", F.coalesce("within", "across").alias("next"))
    return joined.select(*KEY, "half", *[F.col(f"next.{c}").alias(f"next{c}") for c in KEY])


def fingerprint_documents(docs: DataFrame, chain: int = 2) -> DataFrame:
    """doc_id, n_chars, edited, signs, edited_signs, near_edited, near_next for every row of ``docs`` (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's. Null texts are empty. The next document is the next distinct row by doc_id, of rows that share an id
    the next by the text's hash; null ids come first; a single row follows itself. Repeated rows
    give the same result each. Texts are signed whole, however long. Other columns, whatever their names, are ignored. An empty table gives no rows.

    A text is signed where it is read. Its successor gives the document only the start that it needs, and its signatures.
    """
    source = keyed_documents(docs).withColumn("signs", signatures(F.col("text"), chain))
    ahead = following_documents(docs)
    before = ahead.select(*[F.col(f"next{c}").alias(c) for c in KEY], *[F.col(c).alias(f"for{c}") for c in KEY], "half")
    # one of identical rows: lag() shares the join's exchange and sort, and both joins share the exchange of the signed texts
    repeat = F.lag(F.lit(1)).over(Window.partitionBy(*KEY).orderBy(*KEY))
    nexts = source.withColumn("_repeat", repeat).where(F.col("_repeat").isNull()).join(before.hint("merge"), [*KEY])
    start = F.substring("text", F.lit(1), F.col("half")).alias("next_start")
    nexts = nexts.select(*[F.col(f"for{c}").alias(c) for c in KEY], start, F.col("signs").alias("next_signs"))
    pairs = source.join(nexts.hint("merge"), [*KEY])
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - F.floor(F.length("text") / 2).cast("int")), F.col("next_start"))
    signed = pairs.select(
        F.when(F.col("_real"), F.col("_id")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited"),
        "signs",
        signatures(edited, chain).alias("edited_signs"),
        "next_signs",
    )
    return signed.select(
        "doc_id",
        "n_chars",
        "edited",
        "signs",
        "edited_signs",
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"),
        likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


#: Classes of a signature that one task compares with all others that have it.
LIST_PART = 1024


def similar_documents(signed: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id, n_links for every row of ``signed`` (doc_id, signs): the join of fingerprints with themselves.

    Equal fingerprints are one class, named by its smallest doc_id; n_links is the number of other classes with a
    Jaccard similarity of ``threshold`` or more. Empty fingerprints and null ids link with nothing, their class is their own id.

    Classes are partitioned by set length in steps of the threshold, so that a class meets its own partition and the next
    shorter one only. Within, two sets are compared that share one of their rarest n - ceil(threshold * n) + 1
    signatures, as all similar ones do, and whose lengths allow it. Repeated ids count as one document. Very long sets and other columns
    are as any; an empty table gives no rows.
    """
    scratch = Scratch(signed.sparkSession, "spots")
    able = signed.where(F.col("doc_id").isNotNull() & (F.size("signs") > 0))
    keyed = able.select("doc_id", "signs", F.size("signs").alias("n"), F.xxhash64("signs").alias("k1"), F.xxhash64(F.lit(5), "signs").alias("k2"))
    keys = ["n", "k1", "k2"]
    classes = scratch.write(keyed.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.first("signs").alias("signs")), "classes")
    rows = classes.select("rep", "n", F.explode("signs").alias("sig"))
    counts = scratch.write(rows.groupBy("sig").agg(F.count("*").alias("f")).where("f > 1"), "counts")
    ranked = rows.join(counts.hint("merge"), "sig", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    rare = F.slice(F.sort_array(F.collect_list(F.struct("f", "sig"))), 1, F.first("n") - F.ceil(F.first("n") * threshold - 1e-9).cast("int") + 1)
    prefix = ranked.groupBy("rep", "n").agg(rare.alias("rare")).select("rep", "n", F.explode("rare").alias("x")).where("x.f > 1")
    part = F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold) + 1e-9)
    prefix = scratch.write(prefix.select("rep", "n", F.col("x.sig").alias("sig"), part.alias("part")), "prefix")
    # a signature that very many classes have in their prefixes is dealt to several tasks
    tasks = prefix.groupBy("sig").agg(F.ceil(F.count("*") / LIST_PART).alias("tasks"))
    dealt = scratch.write(prefix.join(tasks.hint("merge"), "sig"), "dealt")
    longer = dealt.select("sig", "part", F.pmod(F.xxhash64("rep"), "tasks").alias("task"), F.col("rep").alias("a"), F.col("n").alias("n_a"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")
    shorter = dealt.select("sig", "part", every, F.col("rep").alias("b"), F.col("n").alias("n_b"))
    shorter = shorter.select("sig", F.explode(F.array("part", F.col("part") + 1)).alias("part"), "task", F.col("part").alias("own"), "b", "n_b")
    met = longer.join(shorter.hint("merge"), ["sig", "part", "task"]).where((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))
    met = met.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9).select("a", "b").distinct()
    sets = classes.select("rep", "signs")
    judged = met.join(sets.select(F.col("rep").alias("a"), F.col("signs").alias("s")), "a").join(sets.select(F.col("rep").alias("b"), F.col("signs").alias("t")), "b")
    links = judged.where(likeness(F.col("s"), F.col("t")) >= threshold).select(F.explode(F.array("a", "b")).alias("rep"))
    links = scratch.write(links.groupBy("rep").agg(F.count("*").alias("n_links")), "links")
    members = keyed.join(classes.select(*keys, "rep"), keys).join(links, "rep", "left").select("doc_id", F.col("rep").alias("class_id"), "n_links").distinct()
    members = members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    found = signed.select("doc_id").join(members, "doc_id", "left")
    return found.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

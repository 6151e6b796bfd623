"""Spot signatures of documents, with DataFrame functions only (operator 2).

Each common word (anchor) starts a chain of the next content words, common words skipped however
many; the chain's hash is a signature. The sorted distinct signatures of a text are its fingerprint.
Similarity joins partition sets by length, so that only neighbouring partitions are compared, take
candidates from the first signatures of each set in a common order, and compare no pair that its
lengths rule out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.llm.batches import Buckets, fresh
from palimpsest.runtime import Scratch, stored

#: Common words of English, German, French and Spanish; each is an anchor.
COMMON = (
    "the of and to in a is that it on for was with as be by this are at an from or he his not but have had were which "
    "der die das und den von zu mit sich des dem ein eine ist im nicht auf für als auch es "
    "le la les de des et un une du que qui en dans est pour pas sur au avec ce se il "
    "el los las y del una por con no su para al lo como más"
).split()
#: Content words of a chain.
CHAIN = 2
#: Ordered neighbours: rows of a bucket about.
BUCKET_ROWS = 400
#: Sets of a bucket that one task compares with as many others.
BLOCK = 2048
#: Least similarity of a link.
THRESHOLD = 0.8
_MARK = "\u0001"


def _prefix_tree(words: list[str]) -> str:
    """A pattern of the words by shared prefixes; each position has few branches to try."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = [h + _prefix_tree(rest) for h, rest in sorted(heads.items()) if h]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return "" if not parts else f"(?:{body})?" if "" in heads else body


def normal(text: Column) -> Column:
    """Lower-case words between single spaces, a space at each end."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def with_signatures(df: DataFrame, text_col: str, name: str, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted distinct 64-bit signatures of a text column (not null).

    Each common word is tied to the word behind it, so the pieces between spaces are content words,
    each with the run of anchors before it, of any length. A text without a whole chain gives the
    hashes of its three-word windows; one with fewer words, a hash of itself. The empty text gives
    none. Steps are columns of their own, so that each pattern runs once a row.
    """
    text, plain, pieces, content = F.col(text_col), fresh(df, "__plain"), fresh(df, "__pieces"), fresh(df, "__content")
    none = F.array().cast("array<bigint>")
    tied = F.regexp_replace(F.col(plain), f"(?<= )({_prefix_tree(sorted(set(COMMON)))}) ", f"$1{_MARK}")
    df = df.withColumn(plain, normal(text)).withColumn(pieces, F.split(F.trim(tied), " "))
    df = df.withColumn(content, F.filter(F.transform(pieces, lambda p: F.substring_index(p, _MARK, -1)), lambda w: w != ""))

    def of_piece(p: Column, i: Column) -> Column:
        link = F.xxhash64(*[F.get(F.col(content), i + j) for j in range(chain)])
        anchors = F.split(p, _MARK)
        return F.when(p.contains(_MARK) & (i + chain <= F.size(content)), F.transform(F.slice(anchors, F.lit(1), F.size(anchors) - 1), lambda a: F.xxhash64(a, link))).otherwise(none)

    def of_words(w: Column) -> Column:
        return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array(F.xxhash64(text)))

    df = df.withColumn(name, F.flatten(F.transform(pieces, of_piece)))
    # a lambda over one array: its words are split once, and only where they are asked for
    whole = F.when(text == "", none).otherwise(F.get(F.transform(F.array(F.split(F.trim(F.col(plain)), " ")), of_words), 0))
    return df.withColumn(name, F.array_sort(F.array_distinct(F.when(F.size(name) > 0, F.col(name)).otherwise(whole)))).drop(plain, pieces, content)


def as_text(sigs: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits a signature."""
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_jaccard(df: DataFrame, a: str, b: str, name: str, least: float = 0.0) -> DataFrame:
    """``df`` with the similarity of two signature sets; two empty sets are alike. Sets whose lengths alone put them below ``least``: 0, without a comparison."""
    low, high = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    pruned = (low == 0) | (low < F.lit(least) * high)
    df = df.withColumn("__common", F.when(pruned, F.lit(0)).otherwise(F.size(F.array_intersect(a, b))))
    value = F.when(high == 0, F.lit(1.0)).otherwise(F.col("__common").cast("double") / (F.size(a) + F.size(b) - F.col("__common")))
    return df.withColumn(name, value).drop("__common")


def length_partition(size: Column, threshold: float) -> Column:
    """Sets of similarity ``threshold`` lie in the same or the next partition."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.lit(-math.log(threshold))).cast("long")


def _dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``row`` and ``column``: a bucket of many sets is dealt to a grid of ``BLOCK`` by ``BLOCK`` of them, each cell a join key of its own."""
    nl, nr = (side.groupBy("sig", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(n)) for side, n in ((left, "rows"), (right, "columns")))
    large = nl.join(nr, ["sig", "part"]).where("rows > 1 or columns > 1")
    spread = lambda c, n: F.pmod(F.xxhash64(c, F.lit(7)), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    left = left.join(large, ["sig", "part"], "left").select("a", "na", "sig", "part", "same", spread("a", F.col("rows")).alias("row"), every(F.col("columns")).alias("column"))
    right = right.join(large, ["sig", "part"], "left").select("b", "nb", "sig", "part", spread("b", F.col("columns")).alias("column"), every(F.col("rows")).alias("row"))
    return left, right


def _digests(sigs: Column) -> list[Column]:
    """128 bits of a signature set."""
    return [F.xxhash64(F.lit(17), sigs).alias("d1"), F.xxhash64(F.lit(4711), sigs).alias("d2")]


def signature_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash, sigs, d1, d2`` of the rows with an id and a text that is not empty; ``hash`` is the text's."""
    texts = docs.where(docs[id_col].isNotNull() & (F.coalesce(docs[text_col], F.lit("")) != "")).select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    made = with_signatures(texts, "text", "sigs")
    return made.select("doc_id", F.xxhash64("text").alias("hash"), "sigs", *_digests(F.col("sigs")))


def numbered_classes(sets: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Classes of equal sets: ``rep`` (a number), digest, ``class_id`` (smallest id), ``sigs, n, part``."""
    grouped = sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.first("sigs").alias("sigs"))  # equal digests, equal sets
    made = grouped.withColumn("n", F.size("sigs")).withColumn("part", length_partition(F.col("n"), threshold))
    return scratch.stored(made.withColumn("rep", F.monotonically_increasing_id()), "classes")


def linked_classes(classes: DataFrame, threshold: float, order: str = "sigs") -> DataFrame:
    """``a, b, similarity``: pairs of classes that reach the threshold.

    Sets of similarity ``threshold`` share a signature among the first ``n - ceil(threshold * n) + 1``
    of each in any common order, and lie in neighbouring length partitions, so only those meet. A
    signature that many sets share is dealt to a grid of tasks. What lengths rule out is not
    compared. ``part`` must have been made for this threshold.
    """
    prefix = classes.select("rep", "n", "part", F.explode(F.slice(order, F.lit(1), (F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).cast("int"))).alias("sig"))
    around = [F.struct((F.col("part") + d).alias("part"), F.lit(d == 0).alias("same")) for d in (0, 1)]
    left = prefix.select(F.col("rep").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array(*around)).alias("at")).select("a", "na", "sig", "at.part", "at.same")
    right = prefix.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "sig", "part")
    left, right = _dealt(left, right)
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")) & ((F.col("a") < F.col("b")) | ~F.col("same"))
    pairs = left.join(right, ["sig", "part", "row", "column"]).where(near).select("a", "b").distinct()
    sa, sb = (classes.select(F.col("rep").alias(c), F.col("sigs").alias(f"s{c}")) for c in "ab")
    found = with_jaccard(pairs.join(sa, "a").join(sb, "b"), "sa", "sb", "similarity", threshold)
    return found.select("a", "b", "similarity").where(F.col("similarity") >= threshold)


def similar(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes (``doc_id, class_id``) and similar pairs of class representatives (``a, b, similarity``).

    Equal fingerprints form a class, named by its smallest id, so copies are never paired. The
    rarest signatures of each set meet first, so what many unlike texts hold joins few. Empty texts
    and null ids are in no class; an id beside several texts is in the class of each.
    """
    scratch = Scratch(docs.sparkSession)
    sets = scratch.stored(signature_sets(docs, id_col, text_col), "sets")
    classes = numbered_classes(sets, scratch, threshold)
    entries = classes.select("rep", F.explode("sigs").alias("sig"))
    counts = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("df"))
    ranked = entries.join(counts, "sig").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("order"))
    ranked = classes.join(ranked.select("rep", F.transform("order", lambda e: e["sig"]).alias("order")), "rep")
    name = lambda c: classes.select(F.col("rep").alias(c), F.col("class_id").alias(f"class_{c}"))
    found = linked_classes(ranked, threshold, "order").join(name("a"), "a").join(name("b"), "b")
    pairs = found.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"), "similarity")
    return sets.select("doc_id", "d1", "d2").join(classes.select("d1", "d2", "class_id"), ["d1", "d2"]).select("doc_id", "class_id"), pairs


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, hash, d1, d2, class_id`` of the rows with an id and a text: rows of equal fingerprint are a class, named by its smallest id."""
    members = stored(signature_sets(docs, id_col, text_col).drop("sigs"), "members")
    return members.join(members.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id")), ["d1", "d2"])


def placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Buckets]:
    """``doc_id, text, __key, __hash, __bucket, __ghost`` of all rows, and the buckets.

    Rows are ordered by descending id, then hash of the text, then text; null ids come last and null
    text counts as empty. A bucket also gets the first rows of the bucket below, as ghosts behind its
    own, the last one those of the first: so each row's next one is in its bucket.
    """
    least = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), F.coalesce(docs[id_col].cast("long"), least).alias("__key"), F.xxhash64(text).alias("__hash"))
    buckets = Buckets.of(rows, "__key", BUCKET_ROWS)
    rows = rows.withColumn("__bucket", buckets(F.col("__key"), F.col("__hash")))
    place = F.struct("__key", "__hash")
    tops = rows.groupBy("__bucket").agg(F.max(place).alias("__top"))  # one row a bucket: a million at most
    order = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    target = F.coalesce(F.lead("__bucket").over(order), F.first("__bucket").over(order))
    rows = rows.join(F.broadcast(tops.select("__bucket", "__top", target.alias("__target"))), "__bucket")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("g"))
    ghost = F.struct(F.col("__target").alias("b"), F.lit(1).alias("g"))
    sent = rows.select("doc_id", "text", "__key", "__hash", F.explode(F.when(place == F.col("__top"), F.array(own, ghost)).otherwise(F.array(own))).alias("__at"))
    return sent.select("doc_id", "text", "__key", "__hash", F.col("__at.b").alias("__bucket"), F.col("__at.g").alias("__ghost")), buckets


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """The contract's rows, and for each document its class of equal fingerprints.

    Null text is empty: it has no signatures, is like another empty text and in no class (``class_id``
    null). Null ids come last in the order and are in no class; rows of equal id follow by hash of
    the text; repeated rows are rows of their own. Texts of any length are taken whole; an empty
    table gives no rows; columns not named are ignored. Classes ride through the
    exchange that brings neighbours together, so texts are shuffled once.
    """
    rows, buckets = placed(docs)
    found = fingerprint_classes(docs)
    key = F.col("doc_id").cast("long")
    riders = found.select("doc_id", F.lit(None).cast("string").alias("text"), key.alias("__key"), F.col("hash").alias("__hash"), buckets(key, F.col("hash")).alias("__bucket"), F.lit(2).alias("__ghost"), "d1", "d2", "class_id")
    rows = rows.unionByName(riders, allowMissingColumns=True)
    window = Window.partitionBy("__bucket").orderBy(F.col("__ghost"), F.desc("__key"), F.desc("__hash"), F.desc("text"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("__next", F.lead("text").over(window))
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - cut), F.substr(F.coalesce("__next", F.lit("")), F.lit(1), cut))
    made = rows.withColumn("n_chars", n.cast("long")).withColumn("__edited", edited).drop("__next")
    made = with_signatures(made, "text", "__own").withColumn("__theirs", F.lead("__own").over(window)).where("__ghost <> 1")
    d1, d2 = _digests(F.col("__own"))
    made = made.select("doc_id", "n_chars", "__edited", "__own", "__theirs", "__ghost", "__bucket", "class_id", F.coalesce("d1", d1).alias("d1"), F.coalesce("d2", d2).alias("d2"))
    same = Window.partitionBy("__bucket", "doc_id", "d1", "d2")  # within the bucket: no further exchange
    made = made.withColumn("class_id", F.max("class_id").over(same)).where("__ghost = 0")
    made = with_signatures(made, "__edited", "__changed")
    made = with_jaccard(with_jaccard(made, "__own", "__changed", "near_edited"), "__own", "__theirs", "near_next")
    return made.select(
        "doc_id", "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("__own")).alias("fingerprint"), as_text(F.col("__changed")).alias("edited_fingerprint"),
        "near_edited", "near_next", "class_id",
    )

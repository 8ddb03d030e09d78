"""The trie of conversation prefixes, with sums over subtrees from its Euler tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewatch.llm.common import Shelf, emit, parts, pieces_of
from casewatch.llm.list_rank import END, SMALL, ranks
from casewatch.operators.ranks import partition_of, placed, ranked, running_sums, runs

WORD = "[^\\x20\\x09-\\x0D]+"
BLOCK = 1024  # turns of a conversation whose running prefix is computed together
CHUNK = 1 << 15  # ids of a node that are joined to one string
NODE = ["depth", "p1", "p2"]
DIGEST = pa.schema([("depth", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("ends_sha256", pa.string())])


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``digest`` of role and text, ``n_words`` and ``_place`` of every turn, stored in the order of
    conversation, turn (null first), role and text. A null role or text is empty; rows without a conversation are none."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("digest")
    words = F.expr(f"regexp_count(text, r'{WORD}')").cast("long").alias("n_words")
    return placed(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], digest, words, name="turns")


def positioned(turns: DataFrame, spans: DataFrame) -> DataFrame:
    """Turns beside the run of their partition, with their place ``at`` in the conversation; ``spans`` has the columns of ``runs`` and more."""
    spans = spans.withColumnRenamed("conv_id", "c")
    rows = turns.join(spans, (F.col("conv_id") == F.col("c")) & (partition_of() == F.col("_part"))).drop("c")
    return rows.withColumn("at", F.col("_place") - F.col("_first") + F.col("_before") + 1)


def crossed(turns: DataFrame, width: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that open like the first of their block of ``width`` ids.

    Conversation c takes the first h turns of c - c % width (SQL remainder; all if fewer, none if absent) in place of its own first h,
    h = crc32(c) % (most + 1). Returns the rebuilt turns (``conv_id``, ``depth``, ``digest``, ``n_words``) and all
    conversations (``conv_id``), turnless ones too. Positions of own turns come from the run of a partition, so
    no join meets all rows of a large conversation under one key.
    """
    lead = F.col("conv_id") - F.col("conv_id") % width
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).alias("h")
    held = runs(turns, "conv_id")
    convs = held.select("conv_id").distinct().select("conv_id", lead.alias("lead"), h)
    opening = positioned(turns.where(F.col("conv_id") % width == 0), held.where(F.col("_before") < most)).where(F.col("at") <= most)
    opening = opening.select(F.col("conv_id").alias("lead"), F.col("at").alias("depth"), "digest", "n_words")
    first = convs.join(opening, "lead").where(F.col("depth") <= F.col("h")).select("conv_id", "depth", "digest", "n_words")
    known = opening.groupBy("lead").agg(F.max("depth").alias("known"))
    shift = convs.join(known, "lead", "left").select("conv_id", "h", F.least("h", F.coalesce("known", F.lit(0).cast("long"))).alias("taken"))
    own = positioned(turns, held.join(shift, "conv_id")).where(F.col("at") > F.col("h"))
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "digest", "n_words")
    return first.unionByName(own), convs.select("conv_id")


def as_given(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns and conversations as they are, in the form of ``crossed``."""
    held = runs(turns, "conv_id")
    rows = positioned(turns, held).select("conv_id", F.col("at").alias("depth"), "digest", "n_words")
    return rows, held.select("conv_id").distinct()


def prefixes(turns: DataFrame) -> DataFrame:
    """Each turn with the names of the prefix that ends with it (``p1``, ``p2``) and of the one before (``q1``, ``q2``).

    A prefix is named by 128 bits: the exclusive or, over its turns, of a hash of place and turn. Running
    values are computed in blocks of a conversation and joined to the totals of earlier blocks, so a
    conversation of any length is spread over tasks.
    """
    lane = [F.xxhash64(F.lit(seed), F.col("depth"), F.col("digest")) for seed in (1, 2)]
    rows = turns.select("conv_id", "depth", "n_words", lane[0].alias("h1"), lane[1].alias("h2"), F.floor(F.col("depth") / BLOCK).cast("long").alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    total = rows.groupBy("conv_id", "block").agg(F.bit_xor("h1").alias("t1"), F.bit_xor("h2").alias("t2"))
    before = total.select("conv_id", (F.col("block") + 1).alias("block"), F.bit_xor("t1").over(earlier).alias("t1"), F.bit_xor("t2").over(earlier).alias("t2"))
    rows = rows.withColumns({"p1": F.bit_xor("h1").over(inside), "p2": F.bit_xor("h2").over(inside)}).join(before, ["conv_id", "block"], "left")
    p = [F.coalesce(t, F.lit(0).cast("long")).bitwiseXOR(F.col(v)) for t, v in (("t1", "p1"), ("t2", "p2"))]
    return rows.select(
        "conv_id", "depth", "n_words", p[0].alias("p1"), p[1].alias("p2"),
        p[0].bitwiseXOR(F.col("h1")).alias("q1"), p[1].bitwiseXOR(F.col("h2")).alias("q2"))


def linked(rows: DataFrame, convs: DataFrame, shelf: Shelf) -> DataFrame:
    """One row a node: its id, name, smallest member, members, words, and its parent's id and smallest member."""
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        *[zero.alias(c) for c in (*NODE, "q1", "q2", "n_words")], "conv_id", "n_convs")
    nodes = rows.groupBy(*NODE, "q1", "q2").agg(F.max("n_words").alias("n_words"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    nodes = shelf.put(nodes.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "nodes")
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.where("depth > 0").join(up, ["depth", "q1", "q2"])
    top = nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    return shelf.put(inner.unionByName(top).drop("q1", "q2"), "tree")


def tour(tree: DataFrame, siblings: DataFrame) -> DataFrame:
    """The Euler tour as a list: arc 2 * id enters a node, 2 * id + 1 leaves it; ``next`` is the arc after it, -1 at the end.

    A node is followed by its first child, a child by its next sibling, the last one by the way out of
    the parent. ``near`` is the smallest member: it is the same down a conversation's own path.
    """
    first = siblings.where("place = 1").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    down = tree.select("id", "conv_id").join(first, "id", "left").select(
        (2 * F.col("id")).alias("id"), F.coalesce(2 * F.col("child"), 2 * F.col("id") + 1).alias("next"), F.col("conv_id").alias("near"))
    sibling = siblings.select("parent", (F.col("place") - 1).alias("place"), F.col("id").alias("sibling"))
    on = siblings.join(sibling, ["parent", "place"], "left").select(
        (2 * F.col("id") + 1).alias("id"), F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1).alias("next"), F.col("conv_id").alias("near"))
    out = tree.where("parent IS NULL").select((2 * F.col("id") + 1).alias("id"), F.lit(END).cast("long").alias("next"), F.col("conv_id").alias("near"))
    return down.unionByName(on).unionByName(out)


def subtree_sums(tree: DataFrame, children: DataFrame, siblings: DataFrame, shelf: Shelf, small: int) -> DataFrame:
    """``id``, ``n_leaves``, ``saved_tokens``: over a subtree, the prefix sum at the arc that leaves its top less the one before the arc that enters."""
    ranked_arcs = ranks(tour(tree, siblings), "near", shelf, small)
    n = ranked_arcs.count()
    own = tree.join(children, "id", "left").select(
        "id", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved"))
    arc = ranked_arcs.select((F.lit(n) - F.col("rank")).alias("at"), F.shiftright("id", 1).alias("id"), (F.col("id") % 2).alias("leaves_node"))
    entering = F.col("leaves_node") == 0
    arc = arc.join(own, "id").select("at", "id", "leaves_node", *[F.when(entering, F.col(c)).otherwise(0).alias(c) for c in ("leaf", "saved")], *[F.col(c).alias(f"own_{c}") for c in ("leaf", "saved")])
    summed = running_sums(arc, "at", n, ["leaf", "saved"])
    part = lambda c: F.sum(F.when(entering, F.col(f"own_{c}") - F.col(c)).otherwise(F.col(c)))
    return summed.groupBy("id").agg(part("leaf").alias("n_leaves"), part("saved").alias("saved_tokens"))


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the chunks of a node, which follow each other; only the running hash is held."""
    node, digest, rows = None, None, []
    for batch in pieces_of(batches, 64):
        for d, a, b, _, text in zip(*[c.to_pylist() for c in batch.columns]):
            if (d, a, b) != node:
                rows += [(*node, digest.hexdigest())] if node else []
                node, digest = (d, a, b), hashlib.sha256()
                digest.update(text.encode())
            else:
                digest.update(b"," + text.encode())
        if rows:
            yield emit(DIGEST, **dict(zip(DIGEST.names, zip(*rows))))
            rows = []
    if node:
        yield emit(DIGEST, **dict(zip(DIGEST.names, zip((*node, digest.hexdigest())))))


def ends(rows: DataFrame, convs: DataFrame, shelf: Shelf, chunk: int = CHUNK) -> DataFrame:
    """``ends_sha256`` by node, for nodes at which conversations end.

    The ids are sorted over all partitions and joined to strings of at most ``chunk`` ids. A node with one
    string is hashed where it is. The strings of a larger node go through one running hash in order, as
    SHA-256 allows no other way; the sorting and joining of its ids is spread.
    """
    zero = F.lit(0).cast("long")
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end"))
    last = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(f"end.{c}", zero).alias(c) for c in NODE])
    n = parts(last.sparkSession, convs.count(), 1 << 20)
    order = [*NODE, "conv_id"]
    spread = last.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("chunk", F.floor(F.monotonically_increasing_id() / chunk).cast("long"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    strings = shelf.put(spread.groupBy(*NODE, "chunk").agg(ids.alias("ids")), "ends")
    count = strings.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
    single = strings.join(count.where("n = 1"), NODE).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    several = strings.join(count.where("n > 1").drop("n"), NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return single.unionByName(several.mapInArrow(hashed, "depth long, p1 long, p2 long, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """One row a node of the prefix trie of conversations, from the forms that ``as_given`` and ``crossed`` return.

    A node is a distinct sequence of first turns (role, text), the root the empty one. ``conv_id`` is its smallest
    member, ``n_convs`` counts its members, ``n_leaves`` the childless nodes of its subtree, ``saved_tokens`` the words
    that need not be stored again below it, ``ends_sha256`` the ids that end there. No conversations, no rows.
    """
    shelf = Shelf(turns.sparkSession, "trie")
    rows, convs = shelf.put(prefixes(turns), "prefixes"), shelf.put(convs, "conversations")
    tree = linked(rows, convs, shelf)
    if tree.isEmpty():
        return tree.select("conv_id", "depth", "parent_conv_id", "n_convs", *[F.lit(0).cast("long").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.lit("").alias("ends_sha256"))
    siblings = shelf.put(ranked(tree.where("parent IS NOT NULL"), "parent", [F.col("conv_id")], "id", "conv_id", out="place"), "siblings")
    children = siblings.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    below = subtree_sums(tree, children, siblings, shelf, small)
    none = hashlib.sha256(b"").hexdigest()
    return (
        tree.join(below, "id").join(children, "id", "left").join(ends(rows, convs, shelf, chunk), NODE, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    )


def report(conversations: DataFrame, small: int = SMALL, chunk: int = CHUNK) -> DataFrame:
    """The trie of the crossed conversations.

    A null turn comes first; turns of one number go by role, then text; repeated rows are turns of their own. A null
    role or text is empty; rows without ``conv_id`` are left out. Conversations and texts of any length count whole. An
    empty table gives no rows. Other columns, whatever their names, are not read.
    """
    return trie(*crossed(turns_in_order(conversations)), small=small, chunk=chunk)


def oracle() -> str:
    """SQL with the same result; crc32 is spelled out bit by bit, as the dialect has none."""
    crc = """xor(list_reduce(range(8 * length(c::VARCHAR)), lambda acc, i:
        xor((CASE WHEN i % 8 = 0 THEN xor(acc, ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE acc END) >> 1,
            3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(acc, ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE acc END) & 1)),
        4294967295), 4294967295)"""
    return f"""
    WITH t AS (
      SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS u,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    given AS (SELECT c, list(u ORDER BY pos) AS s, {crc} % 4 AS h FROM t GROUP BY c),
    built AS (SELECT g.c, list_concat(coalesce(l.s, [])[1:g.h], g.s[g.h + 1:]) AS s FROM given g LEFT JOIN given l ON l.c = g.c - g.c % 20),
    m AS (SELECT c, s[1:d] AS k, d, d = len(s) AS ended FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
    n AS (
      SELECT k, d, min(c) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
             (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].x, '{WORD}')) END AS own
      FROM m GROUP BY k, d),
    kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
    w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k, d)),
    below AS (
      SELECT m.k, m.d, sum(w.own) AS saved_tokens, count(*) FILTER (w.n_children = 0) AS n_leaves
      FROM w JOIN m ON m.c = w.conv_id AND m.d <= w.d GROUP BY m.k, m.d)
    SELECT w.conv_id, w.d::BIGINT AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, b.n_leaves,
           b.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
    FROM w JOIN below b USING (k, d) LEFT JOIN n p ON w.d > 0 AND p.d = w.d - 1 AND p.k = w.k[1:w.d - 1]
    """

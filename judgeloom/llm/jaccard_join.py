"""Exact Jaccard join of shingle sets with a token-group matrix.

Similar documents are put into groups, each group's tokens are united, and the
matrix says which group has which token.  A query's overlap with a group's
union bounds its overlap with every member; only groups whose bound reaches the
threshold are opened, and their members compared one by one.

Before that, documents that can't have a partner leave, by exact bounds:

1. Documents with the same set form a class; one row goes on for all.
2. Tokens are ordered by hash.  Two sets whose overlap must be at least O share
   k of their first ``size - O + k`` tokens; with k a quarter of the size that
   is half of a set.  A keyed exchange tells which of those tokens any other
   document has.  Documents that share too few of them have no partner.
3. Of the sets that are left, a second exchange counts all tokens: a set less than
   three quarters of whose tokens are in other sets has no partner either.  With
   rare tokens first, partners share one of a set's first quarter.  The
   smallest document of any such token is a document's *centre*; documents of
   one centre make a block, large blocks are split by hash.

Within a block the matrix joins all documents.  A block's leaders (one document
of each linked group) are then joined per centre, so that groups split over
blocks unite.  What may still be missed are links between different groups of
different blocks; for those, documents of the smaller group are sent as queries
to the blocks that share a prefix token with them, and meet the matrix there.
So copies in large numbers aren't expanded into pairs and no bound is a guess:
every pair that reaches the threshold is either found or already connected.

Results for odd inputs: null, empty or blank texts have no shingles and are
linked with nothing; a text of fewer words than a shingle is one shingle.  All
work is done on rows, by numbers of their own.  Rows of one id are one document:
what is linked to any of them is linked to all, rows without words included.
Each row of a null id is a document of its own, which links like any other; a
component's id is the smallest id in it that isn't null, or null if there is
none.  An empty table gives an empty table; other columns are ignored.
``drop_near_copies`` goes by rows throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packs as P
from .components import components
from .hashing import mix, windows

TOKENS, CLASSES = 0, 1
#: A block is split beyond so many documents or tokens.
BLOCK_DOCS, BLOCK_TOKENS = 256, 400_000
QUERIES = 512


class Threshold:
    """Integer bounds for |x & y| / |x | y| >= share."""

    def __init__(self, share: Fraction) -> None:
        self.p, self.q = share.numerator, share.denominator

    def least(self, n):
        """Least overlap, and least size of a partner, of a set of n."""
        return -(-n * self.p // self.q)

    def shared(self, n):
        """k of a set of n: how many tokens partners share in their prefixes."""
        return np.maximum(1, n - self.least(n))

    def prefix(self, n):
        return np.minimum(n, n - self.least(n) + self.shared(n))

    def needed(self, n):
        """Tokens that a partner of any size shares with the prefix of n."""
        return np.minimum(self.shared(n), self.shared(np.maximum(1, self.least(n))))

    def links(self, both: int, a: int, b: int) -> bool:
        return both > 0 and self.q * both >= self.p * (a + b - both)


class _Sets:
    """Shingle sets of a pack: hashes[first[i] : first[i] + size[i]], sorted."""

    def __init__(self, pack: P.Pack, width: int) -> None:
        from .substring_dedup import _Words

        w = _Words(pack, width)
        at = np.flatnonzero(w.left >= width)
        doc, h = w.doc[at], w.windows(width)[at]
        for n in range(1, width):  # fewer words are one shingle
            few = np.flatnonzero(w.count == n)
            if len(few):
                doc = np.concatenate([doc, few])
                h = np.concatenate([h, windows(w.codes(), n)[w.first[few]]])
        h = h & np.uint64((1 << 64) - 2)  # the lowest bit is kept for the exchange
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)
        self.doc, self.hashes = doc[new], h[new]
        self.size = np.bincount(self.doc, minlength=len(pack.ids)).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.rank = np.arange(len(self.doc)) - self.first[self.doc] if len(self.doc) else np.zeros(0, np.int64)

    def prefix(self, t: Threshold):
        """Distinct tokens of the prefixes, the lowest bit set where several
        documents of the pack have one; each entry's place; the entries."""
        at = np.flatnonzero(self.rank < t.prefix(self.size)[self.doc]) if len(self.doc) else np.zeros(0, np.int64)
        keys, place, times = np.unique(self.hashes[at], return_inverse=True, return_counts=True)
        return keys | (times > 1).astype(np.uint64), place, at

    def digests(self, ids: np.ndarray):
        """Distinct sets by digest with their smallest id; place and document."""
        docs = np.flatnonzero(self.size > 0)
        zero = np.zeros(0, np.uint64)
        a = np.add.reduceat(mix(self.hashes), self.first[docs]) if len(docs) else zero
        b = np.add.reduceat(mix(self.hashes ^ np.uint64(0x5851F42D4C957F2D)), self.first[docs]) if len(docs) else zero
        a = mix(a + self.size[docs].astype(np.uint64))
        order = np.lexsort((b, a))
        a, b, docs = a[order], b[order], docs[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        edges = np.flatnonzero(new)
        low = np.minimum.reduceat(ids[docs], edges) if len(edges) else np.zeros(0, np.int64)
        return a[edges], b[edges], low, np.cumsum(new) - 1, docs


def _answer(level: int, keys: np.ndarray, b: list, c: list) -> np.ndarray:
    """Tokens: how many have it, 255 at most.  Classes: the smallest id, whose
    eight bytes stand for one code each."""
    if level == TOKENS:
        h = keys >> np.uint64(1)
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        times = np.add.reduceat(1 + (keys[order] & np.uint64(1)).astype(np.int64), np.flatnonzero(new))
        out = np.empty(len(keys), np.uint8)
        out[order] = np.minimum(times, 255)[np.cumsum(new) - 1]
        return out
    check, ids = np.frombuffer(b"".join(b), np.uint64), np.frombuffer(b"".join(c), np.int64)
    order = np.lexsort((check, keys))
    k, d = keys[order], check[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
    out = np.empty(len(keys), np.int64)
    out[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


def _class_ids(pack: P.Pack, n_buckets: int, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), np.int64)
    for bucket, s, e in P.slices(keys, n_buckets):
        out[s:e] = np.frombuffer(pack.replies[CLASSES, bucket].tobytes(), np.int64)
    return out


def shingle_sets(docs: DataFrame, t: Threshold, width: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Checkpointed (row, id, size, rep) of all documents, rep the smallest row
    with the same set; and (doc_id, size, tokens, keys) of representatives that
    may have partners, doc_id being their row."""
    packs = P.pack(docs, P.lower_words_text, id_col, text_col)
    n_buckets = P.bucket_count(packs)

    def ask(pack: P.Pack) -> Iterator[P.Request]:
        sets = _Sets(pack, width)
        a, b, low, _, _ = sets.digests(pack.rows)
        yield from P.requests(TOKENS, n_buckets, sets.prefix(t)[0])
        yield from P.requests(CLASSES, n_buckets, a, b, low)

    def survivors(packs: Iterator[P.Pack]) -> Iterator[pa.RecordBatch]:
        """A row for each document, and one with the sets that go on, as a pack
        whose texts are tokens of eight bytes."""
        for pack in packs:
            sets = _Sets(pack, width)
            a, _, _, place, with_set = sets.digests(pack.rows)
            rep = pack.rows.copy()
            if len(with_set):
                rep[with_set] = _class_ids(pack, n_buckets, a)[place]
            keys, where, at = sets.prefix(t)
            times = P.replied(pack, TOKENS, n_buckets, keys)[where] if len(at) else np.zeros(0, np.uint8)
            shared = np.bincount(sets.doc[at], weights=times > 1, minlength=len(pack.ids))
            goes_on = np.flatnonzero((rep == pack.rows) & (sets.size > 0) & (shared >= t.needed(sets.size)))
            n = len(pack.ids)
            none = [None] * n
            tokens = b"".join(sets.hashes[sets.first[i] : sets.first[i] + sets.size[i]].tobytes() for i in goes_on.tolist())
            rows, sizes = pack.rows[goes_on], 8 * sets.size[goes_on]
            columns = [
                *(pa.concat_arrays([x, pa.nulls(1, pa.int64())]) for x in (pa.array(pack.rows), P.ids_out(pack.ids), pa.array(sets.size), pa.array(rep))),
                *(pa.array([*none, x], pa.int64()) for x in (pack.group_id, pack.pack_id, len(tokens))), *(pa.array([*none, x], pa.binary()) for x in (rows.tobytes(), sizes.tobytes(), P.squeeze(tokens)))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "size", "rep", "group_id", "pack_id", "n_bytes", "ids", "sizes", "text"])

    replies = P.exchange(P.requested(packs, n_buckets, ask), n_buckets, _answer)
    mixed = P.checkpointed(P.finished(packs, n_buckets, survivors, f"row long, id long, size long, rep long, {P.PACK_SCHEMA}", replies))
    every = mixed.where("pack_id is null").select("row", "id", "size", "rep")
    left = mixed.where("pack_id is not null").drop("row", "id", "size", "rep")
    return every, _promising(left, t)


def _promising(packs: DataFrame, t: Threshold) -> DataFrame:
    """Checkpointed (doc_id, size, tokens, keys, places) of the sets enough of
    whose tokens occur in other sets of the packs; keys are the shared ones
    among the rarest tokens, at least one of which every partner has, and places
    how many tokens of the set are rarer."""
    n_buckets = P.bucket_count(packs)

    def distinct(pack: P.Pack):
        keys, place, times = np.unique(pack.buf.view(np.uint64), return_inverse=True, return_counts=True)
        return keys | (times > 1).astype(np.uint64), place

    def ask(pack: P.Pack) -> Iterator[P.Request]:
        return P.requests(TOKENS, n_buckets, distinct(pack)[0])

    def choose(packs: Iterator[P.Pack]) -> Iterator[pa.RecordBatch]:
        for pack in packs:
            keys, place = distinct(pack)
            times = P.replied(pack, TOKENS, n_buckets, keys)[place] if len(keys) else np.zeros(0, np.uint8)
            h = pack.buf.view(np.uint64)
            ids, sizes, tokens, chosen, places = [], [], [], [], []
            for doc_id, s, e in zip(pack.ids.tolist(), (pack.starts // 8).tolist(), (pack.ends // 8).tolist(), strict=True):
                n, own = e - s, times[s:e]
                if np.count_nonzero(own > 1) < t.least(n):
                    continue
                rare = np.lexsort((h[s:e], own))[: n - t.least(n) + 1]
                ids.append(doc_id)
                sizes.append(n)
                tokens.append(h[s:e].tobytes())
                common = np.flatnonzero(own[rare] > 1)
                chosen.append(h[s:e][rare[common]].view(np.int64))
                places.append(common)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary()), pa.array(chosen, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], names=["doc_id", "size", "tokens", "keys", "places"])

    replies = P.exchange(P.requested(packs, n_buckets, ask), n_buckets, _answer)
    return P.checkpointed(P.finished(packs, n_buckets, choose, "doc_id long, size long, tokens binary, keys array<long>, places array<long>", replies))


class TokenGroupMatrix:
    """Groups of documents, the union of each group's tokens, and the members."""

    def __init__(self, t: Threshold, n_tokens: int, capacity: int) -> None:
        self.t = t
        self.has = np.zeros((max(1, capacity), n_tokens), bool)
        self.members: list[list[int]] = []
        self.least: list[int] = []

    def add(self, doc: int, tokens: np.ndarray, size: int, group: int | None = None) -> int:
        if group is None:
            group = len(self.members)
            self.members.append([])
            self.least.append(size)
        self.has[group, tokens] = True
        self.members[group].append(doc)
        self.least[group] = min(self.least[group], size)
        return group

    def qualifying(self, tokens: np.ndarray, size: int) -> list[int]:
        """Groups with a union that shares enough tokens with the query for any
        member to reach the threshold."""
        n = len(self.members)
        if not n or not len(tokens):
            return []
        bound = self.has[:n, tokens].sum(axis=1)
        return np.flatnonzero((bound >= self.t.least(size)) & (bound >= self.t.least(np.array(self.least)))).tolist()

    def merge(self, into: int, other: int) -> None:
        """Moves a group's members; the emptied group bounds nothing more."""
        self.has[into] |= self.has[other]
        self.has[other] = False
        self.members[into] += self.members[other]
        self.least[into] = min(self.least[into], self.least[other])
        self.members[other] = []


class _Block:
    """Documents of a block with their tokens as small numbers: those that at
    least two of the documents have."""

    def __init__(self, ids: list[int], blobs: list[bytes]) -> None:
        self.ids = ids
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        self.size = [len(s) for s in sets]
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        _, place, times = np.unique(every, return_inverse=True, return_counts=True)
        code = np.cumsum(times > 1) - 1
        cuts = np.cumsum([0, *self.size])
        self.tokens = [code[p[times[p] > 1]] for p in (place[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True))]
        self.n_tokens = int(code[-1]) + 1 if len(code) else 0

    def linked(self, t: Threshold, a: int, b: int) -> bool:
        x, y = self.tokens[a], self.tokens[b]
        return t.links(len(np.intersect1d(x, y, assume_unique=True)), self.size[a], self.size[b])


def _links_within(block: _Block, t: Threshold) -> list[tuple[int, int]]:
    """Joins the documents of a block; one edge for each but the first of a
    group of connected ones."""
    order = sorted(range(len(block.ids)), key=lambda i: (-block.size[i], block.ids[i]))
    matrix = TokenGroupMatrix(t, block.n_tokens, len(order))
    for i in order:
        home = None
        for g in matrix.qualifying(block.tokens[i], block.size[i]):
            if any(block.linked(t, i, m) for m in matrix.members[g]):
                if home is None:
                    home = g
                else:
                    matrix.merge(home, g)
        matrix.add(i, block.tokens[i], block.size[i], home)
    out = []
    for members in matrix.members:
        ids = sorted(block.ids[m] for m in members)
        out += [(ids[0], x) for x in ids[1:]]
    return out


def _links_to(block: _Block, groups: list[int], query: list[bool], t: Threshold) -> list[tuple[int, int]]:
    """Links of queries to the groups of a block's other documents."""
    matrix, of = TokenGroupMatrix(t, block.n_tokens, len(block.ids)), {}
    for i, g in enumerate(groups):
        if not query[i]:
            of[g] = matrix.add(i, block.tokens[i], block.size[i], of.get(g))
    label = {m: g for g, m in of.items()}
    out = []
    for i, g in enumerate(groups):
        if query[i]:
            for k in matrix.qualifying(block.tokens[i], block.size[i]):
                if label[k] != g and (m := next((m for m in matrix.members[k] if block.linked(t, i, m)), None)) is not None:
                    out.append((block.ids[i], block.ids[m]))
    return out


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _joined(blocks: DataFrame, t: Threshold) -> DataFrame:
    """Edges within each (home, part) of blocks."""

    def join(table: pa.Table) -> pa.Table:
        return _edges(_links_within(_Block(table.column("doc_id").to_pylist(), table.column("tokens").to_pylist()), t))

    return P.checkpointed(blocks.select("home", "part", "doc_id", "tokens").groupBy("home", "part").applyInArrow(join, "a long, b long"))


def _split(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """rows(doc_id, home, size) with the column part: by hash, as many parts of
    a home as its documents and tokens ask for."""
    return rows.join(sized, "home").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")


def _parts(rows: DataFrame) -> DataFrame:
    docs, tokens = F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_TOKENS)
    return rows.groupBy("home").agg(F.greatest(docs, tokens, F.lit(1)).cast("long").alias("parts"))


def similar_components(docs: DataFrame, share: Fraction | str = "0.75", shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): documents are linked if the Jaccard
    similarity of their sets of word shingles is at least ``share``; a
    component's id is the smallest doc_id in it."""
    t = Threshold(Fraction(share))
    sets, promising = shingle_sets(docs, t, shingle, id_col, text_col)
    tokens = promising.select("doc_id", "size", "tokens")
    keys = promising.select("doc_id", "size", F.inline(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))))
    centres = keys.groupBy("key").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("other")).where("centre < other").select("key", "centre")
    keys = P.checkpointed(keys.join(centres, "key"))
    homes = keys.groupBy("doc_id", "size").agg(F.min("centre").alias("home"))
    homes = P.checkpointed(_split(homes, _parts(homes)))

    blocks = homes.select("doc_id", "home", "part").join(tokens, "doc_id")
    edges = _joined(blocks, t)

    # Leaders of a home's parts.
    groups = _labelled(homes, edges)
    led = groups.groupBy("home", "part", "group").agg(F.min("doc_id").alias("doc_id"))
    many = led.groupBy("home").agg(F.max("part").alias("last")).where("last > 0").select("home")
    led = led.join(many, "home", "left_semi").select("doc_id", "home").join(tokens, "doc_id")
    edges = P.checkpointed(edges.unionByName(_joined(_split(led, _parts(led)), t)))

    # Links between different groups of different blocks: small groups ask.
    groups = P.checkpointed(_labelled(homes, edges))
    heavy = groups.groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") >= P.heavy_at(groups.count()))
    rank = F.struct(F.coalesce("members", F.lit(0)), "group")
    ranked = P.checkpointed(groups.join(F.broadcast(heavy), "group", "left").select("doc_id", "home", "part", "group", rank.alias("rank")))
    placed = keys.select("key", "doc_id", "size", (F.col("size") - F.col("place")).alias("ahead")).join(ranked, "doc_id")
    mixed = placed.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
    placed = P.checkpointed(placed.join(mixed, "key", "left_semi"))
    most = placed.groupBy("key", F.col("home").alias("to_home"), F.col("part").alias("to_part")).agg(F.max("rank").alias("most"), F.max("ahead").alias("reach"), F.min("size").alias("least"))
    # Tokens before the first common one aren't shared: what is ahead of it in
    # both sets must do for the overlap that their sizes ask for.
    sizes = F.col("size") + F.greatest("least", F.ceil(F.col("size") * t.p / t.q))
    near = (t.p + t.q) * F.least("ahead", "reach") >= t.p * sizes
    sent = placed.join(most, "key").where(F.expr("rank < most and (home <> to_home or part <> to_part)") & near)
    sent = P.checkpointed(sent.select("doc_id", "size", "group", F.col("to_home").alias("home"), F.col("to_part").alias("part")).distinct())
    chunks = F.greatest(F.ceil(F.count("*") / QUERIES), F.ceil(F.sum("size") / BLOCK_TOKENS)).cast("int")
    loads = P.checkpointed(sent.groupBy("home", "part").agg(F.count("*").alias("n"), chunks.alias("chunks")))
    # blocks that very many ask are looked up in a broadcast of 50,000 at most
    often = F.col("n") >= P.heavy_at(sent.count())
    busy = F.broadcast(loads.where(often).drop("n"))
    calm = sent.join(busy.select("home", "part"), ["home", "part"], "left_anti").join(loads.where(~often).drop("n"), ["home", "part"])
    asked = sent.join(busy, ["home", "part"]).unionByName(calm)
    asked = asked.select("home", "part", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"), "doc_id", "group", F.lit(True).alias("query"))
    held = groups.select("doc_id", "group", "home", "part").join(loads, ["home", "part"]).select("home", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "doc_id", "group", F.lit(False).alias("query"))

    def search(table: pa.Table) -> pa.Table:
        c = {n: table.column(n).to_pylist() for n in ("doc_id", "tokens", "group", "query")}
        return _edges(_links_to(_Block(c["doc_id"], c["tokens"]), c["group"], c["query"], t))

    across = asked.unionByName(held).join(tokens.select("doc_id", "tokens"), "doc_id").groupBy("home", "part", "chunk").applyInArrow(search, "a long, b long")
    return _named(sets, components(edges.unionByName(P.checkpointed(across)).unionByName(_of_one_id(sets))))


def _of_one_id(sets: DataFrame) -> DataFrame:
    """Edges between the classes of rows that have one id."""
    there = sets.where("id is not null").select("id", F.col("rep").alias("a"))
    several = P.checkpointed(there.groupBy("id").agg(F.min("a").alias("b"), F.max("a").alias("high")).where("b < high").select("id", "b"))
    if several.isEmpty():
        return sets.sparkSession.createDataFrame([], "a long, b long")
    return P.checkpointed(P.looked_up(there, several, "id").where("b < a").select("a", "b").distinct())


def _named(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows, from their classes and
    the classes' labels.  Rows alone in class and component need no lookup."""
    classes = sets.groupBy("rep").agg(F.min("id").alias("low"), F.count("*").alias("n")).join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    joined = P.checkpointed(classes.where("n > 1 or component is not null").select("rep", F.coalesce("component", "rep").alias("component"), "low"))
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = P.checkpointed(P.looked_up(joined.select("rep", "component"), lows, "component").select("rep", "component_id", F.lit(True).alias("named")))
    out = P.looked_up(sets, named, "rep")
    return out.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("named"), F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _labelled(homes: DataFrame, edges: DataFrame) -> DataFrame:
    labels = components(edges).select(F.col("id").alias("doc_id"), "component")
    return homes.join(labels, "doc_id", "left").select("doc_id", "home", "part", F.coalesce("component", "doc_id").alias("group"))


def drop_near_copies(docs: DataFrame, share: Fraction | str = "0.75", shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, all columns unchanged: the smallest
    id's (null last), of several the first.  Every row is a document of its own,
    whatever its id; rows without words all stay."""
    rows, number = P.numbered(docs)
    found = similar_components(rows, share, shingle, number, text_col).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id")
    found = P.checkpointed(found.join(rows.select(F.col(number).alias("row"), F.col(id_col).alias("id")), "row"))
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("row"))
    return P.without_rows(rows, number, found.join(first.select("row"), "row", "left_anti"))

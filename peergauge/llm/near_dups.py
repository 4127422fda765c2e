"""Near-duplicate documents by MinHash, with exact confirmation.

Documents with equal shingle sets form one class from the start, so exact copies cost nothing later.
A class's signature has one coordinate per hash function: the least hash of its shingles. Classes are
posted under their (coordinate, value) pairs, an inverted index whose lists collide for similar sets:
sets of similarity s agree in a share s of the coordinates on average. A pair is a candidate if it
agrees in at least ``matches`` coordinates. Such a pair agrees in one of any
``coordinates - matches + 1`` coordinates, so each class is posted under that many only, its rarest
values (prefix); the long lists that frequent passages give are mostly not built (skip), and the full
number of agreements is counted from the two signatures.

Groups of very many near copies would give all their pairs. Only the components are asked for, so
candidates are worked off in two steps that each give a few rows per class. First each list is
searched for classes that candidate pairs connect, and a forest of such pairs is kept; its trees are
the clusters that links can lie in. Then clusters are compared in tiles of bounded size: candidates
between components are confirmed on the full sets where they are found, and the links that join
components are kept. Links inside a component need no confirmation: they cannot change it.

A list or cluster that is larger than a tile is compared with its centre first, one row per class.
The classes linked to the centre are connected by it and need not meet each other; only the others are
put into tiles with all the rest, so a large group of near copies costs a few rows per class as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peergauge.llm.common import bounded_batches, slices, whole_text
from peergauge.llm.components import connected_components
from peergauge.llm.text_ids import release_encoders
from peergauge.session import write_shared

COORDINATES = 64
# Chance that a pair just at the threshold is missed: below 1e-4; it falls fast above it.
MISS = 1e-4
# Classes of a list, and shingles of a cluster, that make a chunk; a tile holds two chunks.
LIST_CLASSES = 500
TILE_SHINGLES = 250_000
# Shingles hashed together under one key; three arrays of so many stay in a core's cache.
HASHED_SHINGLES = 32_768
_SEED = 20240229


def least_matches(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The agreements that a pair of this similarity has but with probability ``miss``."""
    below = 0.0
    for n in range(coordinates + 1):
        below += (
            math.comb(coordinates, n) * similarity**n * (1 - similarity) ** (coordinates - n)
        )
        if below > miss:
            return max(n, 1)
    return coordinates


class Shingler:
    """64-bit hashes of the distinct shingles of ``size`` words of each text.

    A-Z count as a-z; words are separated by ASCII white space. A text of fewer words, but at least
    one, has its whole sequence as its one shingle.
    """

    def __init__(self, size: int):
        import xxhash

        release_encoders()
        self._size, self._hash = size, xxhash.xxh3_64_intdigest

    def shingles(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts' sets one after another, each sorted and distinct, and their sizes."""
        hashes, counts = self._words(texts)
        widths = np.minimum(counts, self._size)
        places = np.where(counts > 0, counts - widths + 1, 0)
        ends = np.cumsum(places)
        starts = ends - places
        at = np.arange(places.sum()) + np.repeat(np.cumsum(counts) - counts - starts, places)
        width = np.repeat(widths, places)
        mixed = width.astype(np.uint64)
        for i in range(self._size):
            wide = width > i
            if wide.all():
                mixed = _mix(mixed ^ hashes[at + i])
            else:
                mixed[wide] = _mix(mixed[wide] ^ hashes[at[wide] + i])
        for start, end in zip(starts.tolist(), ends.tolist()):
            mixed[start:end].sort()
        new = np.ones(len(mixed), bool)
        new[1:] = mixed[1:] != mixed[:-1]
        new[starts[places > 0]] = True
        before = np.concatenate([[0], np.cumsum(new)])
        return mixed[new], before[ends] - before[starts]

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the texts' words, and how many each text has; a distinct word is hashed once."""
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        bounds, words = words.offsets.to_numpy(), words.flatten()
        # White space at the ends leaves empty words.
        real = pc.greater(pc.binary_length(words), 0)
        before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
        numbered = words.filter(real).dictionary_encode()
        distinct = numbered.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter(map(self._hash, distinct), np.uint64, len(distinct))
        return hashes[numbered.indices.to_numpy()], np.diff(before[bounds])


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(coordinates: int) -> np.ndarray:
    return np.random.default_rng(_SEED).integers(1, 2**63, coordinates, dtype=np.uint64)


def _signatures(shingles: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Upper 32 bits of the least hash under each key, one row per set that is not empty."""
    counts = counts[counts > 0]
    ends = np.cumsum(counts)
    starts = ends - counts
    least = np.full((len(keys), len(counts)), np.iinfo(np.uint64).max, np.uint64)
    odd = keys | np.uint64(1)
    for low in range(0, len(shingles), HASHED_SHINGLES):
        part = shingles[low : low + HASHED_SHINGLES]
        # A set may begin before this part and end after it.
        held = slice(np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(part)))
        cuts = np.maximum(starts[held] - low, 0)
        hashed, upper = np.empty_like(part), np.empty_like(part)
        for row, key in zip(least, odd):
            np.multiply(part, key, out=hashed)
            np.right_shift(hashed, np.uint64(32), out=upper)
            np.bitwise_xor(hashed, upper, out=hashed)
            np.multiply(hashed, np.uint64(0x9E3779B97F4A7C15), out=hashed)
            np.minimum(row[held], np.minimum.reduceat(hashed, cuts), out=row[held])
    return (least >> np.uint64(32)).astype("<u4").T.copy()


def _sketch(size: int, coordinates: int) -> Callable:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingler, keys = Shingler(size), _keys(coordinates)
        for batch in slices(batches, "text"):
            found, counts = shingler.shingles(batch.column("text"))
            rows = iter(_signatures(found, counts, keys))
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in _each(found, counts)]
            signatures = [next(rows).tobytes() if n else None for n in counts.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(signatures, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_digest", "signature"],
            )

    return sketch


def _each(shingles: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(shingles, np.cumsum(counts)[:-1])


def _postings(coordinates: int) -> Callable:
    """Every (coordinate, value) of a class as one number."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(coordinates, dtype=np.int64) << 32
        for batch in slices(batches, "signature"):
            values = _matrix(batch.column("signature"), coordinates).astype(np.int64)
            classes = np.repeat(batch.column("class").to_numpy(), coordinates)
            yield pa.RecordBatch.from_arrays(
                [pa.array(classes), pa.array((at | values).ravel())], ["class", "posting"]
            )

    return post


def _matrix(signatures: pa.Array, coordinates: int) -> np.ndarray:
    joined = b"".join(signatures.to_pylist())
    return np.frombuffer(joined, "<u4").reshape(-1, coordinates)


def _forest(coordinates: int, matches: int) -> Callable:
    """A list's spanning forest of candidate pairs, by breadth-first search."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def span(tile: pa.Table) -> pa.Table:
        signatures = _matrix(tile.column("signature"), coordinates)
        nodes = tile.column("class").to_numpy()
        settled = tile.column("settled").to_numpy(zero_copy_only=False)
        # In order of the classes, so that lists which share a group give the same pairs.
        left = np.argsort(nodes, kind="stable")
        # What is linked to the centre is one tree already.
        found, left = left[settled[left]].tolist(), left[~settled[left]]
        a, b = [], []
        while len(left):
            if not found:
                found, left = [left[0]], left[1:]
            for i in found:
                near = (signatures[left] == signatures[i]).sum(axis=1) >= matches
                a += [nodes[i]] * int(near.sum())
                b += nodes[left[near]].tolist()
                found += left[near].tolist()
                left = left[~near]
            found = []
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return span


def _joining(coordinates: int, matches: int, percent: int) -> Callable:
    """The links of one tile that join components: candidates, confirmed on the full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(tile: pa.Table) -> pa.Table:
        # The most central classes first: they join most of their group at once.
        tile = tile.sort_by([("central", "descending"), ("class", "ascending")])
        signatures = _matrix(tile.column("signature"), coordinates)
        nodes = tile.column("class").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in tile.column("shingles").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        shingles, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        present = np.zeros(len(shingles), bool)
        part, order = np.arange(len(nodes)), np.arange(len(nodes))
        # What is linked to the centre is one component already.
        settled = tile.column("settled").to_numpy(zero_copy_only=False)
        part[settled] = part[settled].min(initial=len(nodes))
        a, b = [], []
        for i in order:
            others = order[(order > i) & (part != part[i])]
            others = others[(signatures[others] == signatures[i]).sum(axis=1) >= matches]
            if not len(others):
                continue
            own = flat[ends[i] - sizes[i] : ends[i]]
            present[own] = True
            rows = np.concatenate([flat[ends[j] - sizes[j] : ends[j]] for j in others])
            starts = np.cumsum(sizes[others]) - sizes[others]
            common = np.add.reduceat(present[rows].astype(np.int64), starts)
            present[own] = False
            linked = others[100 * common >= percent * (sizes[i] + sizes[others] - common)]
            for j in linked:
                if part[i] != part[j]:
                    a.append(nodes[i])
                    b.append(nodes[j])
                    part[part == part[j]] = part[i]
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    return join


def _against_centre(key: str, coordinates: int, matches: int, percent: int | None) -> Callable:
    """Whether each row is linked to its group's centre: a candidate, and confirmed if ``percent``."""

    def confirmed(own: bytes, centre: bytes) -> bool:
        x, y = np.frombuffer(own, np.uint64), np.frombuffer(centre, np.uint64)
        common = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * common >= percent * (len(x) + len(y) - common)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles" if percent else "signature"):
            own = _matrix(batch.column("signature"), coordinates)
            centre = _matrix(batch.column("centre_signature"), coordinates)
            linked = (own == centre).sum(axis=1) >= matches
            if percent:
                sets, centres = batch.column("shingles"), batch.column("centre_shingles")
                for i in linked.nonzero()[0]:
                    linked[i] = confirmed(sets[i].as_py(), centres[i].as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("class"), batch.column("centre"), pa.array(linked)],
                [key, "class", "centre", "linked"],
            )

    return compare


def _sets(size: int) -> Callable:
    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slices(batches, "text"):
            found = [x.tobytes() for x in _each(*shingler.shingles(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"]
            )

    return shingle


class _Search:
    """One search over the classes of a table of documents."""

    def __init__(self, texts: DataFrame, classes: DataFrame, size: int, percent: int, k: int):
        self._texts, self._classes, self._size, self._percent = texts, classes, size, percent
        self._coordinates, self._matches = k, least_matches(percent / 100, k)

    def posted(self) -> DataFrame:
        """(class, posting, central): each class under its rarest values, of lists of at least two.

        Values that no other class has come first among the rarest; their lists hold no pair, so
        only their number is needed. ``central`` counts the class's collisions in all coordinates:
        of a group of near copies it is largest for the one that most others stem from.
        """
        prefix = self._coordinates - self._matches + 1
        every = self._classes.select("class", "signature").mapInArrow(
            _postings(self._coordinates), "class long, posting long"
        )
        every = write_shared(every, "postings")
        shared = every.groupBy("posting").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # At most one entry per coordinate.
        own = (
            every.join(shared, "posting")
            .groupBy("class")
            .agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("own"))
        )
        room = F.greatest(F.lit(0), F.size("own") - (self._coordinates - prefix))
        central = F.aggregate("own", F.lit(0).cast("long"), lambda total, p: total + p["n"])
        rarest = own.select(
            "class", central.alias("central"), F.explode(F.slice("own", F.lit(1), room)).alias("p")
        )
        return rarest.select("class", F.col("p.posting").alias("posting"), "central")

    def lists(self, posted: DataFrame) -> DataFrame:
        """(posting, total) of the lists to search: of those that hold the same classes only one.

        Near copies meet in most of their postings, and equal lists give equal forests. A class is in
        a list once, so the exclusive or of its classes' hashes, 128 bits, tells lists apart.
        """
        held = posted.groupBy("posting").agg(
            F.count(F.lit(1)).alias("total"),
            F.min("class").alias("least"),
            F.bit_xor(F.xxhash64("class")).alias("digest"),
            F.bit_xor(F.xxhash64("class", F.lit(1))).alias("digest2"),
        )
        alike = held.where("total > 1").groupBy("total", "least", "digest", "digest2")
        return alike.agg(F.min("posting").alias("posting")).select("posting", "total")

    def clusters(self, posted: DataFrame) -> DataFrame:
        """(class, cluster) of the classes that candidate pairs connect with others."""
        rows = posted.join(self.lists(posted), "posting").join(
            self._classes.select("class", "signature"), "class"
        )
        tiles, pairs = self.tiles(rows.withColumn("weight", F.lit(1)), "posting", LIST_CLASSES)
        forest = tiles.groupBy("posting", "low", "high").applyInArrow(
            _forest(self._coordinates, self._matches), "a long, b long"
        )
        candidates = write_shared(forest.union(pairs).distinct(), "candidates")
        trees = connected_components(candidates)
        return trees.select(F.col("node").alias("class"), F.col("component").alias("cluster"))

    def links(self, posted: DataFrame) -> DataFrame:
        """Confirmed links that join components, at most one per class and tile."""
        central = posted.groupBy("class").agg(F.max("central").alias("central"))
        clustered = write_shared(self.clusters(posted).join(central, "class"), "clusters")
        sized = clustered.join(
            self._classes.select("class", F.col("n_shingles").alias("weight"), "signature"), "class"
        )
        volumes = sized.groupBy("cluster").agg(F.sum("weight").alias("total"))
        members = sized.join(volumes, "cluster").join(
            self.sets(clustered).withColumnRenamed("node", "class"), "class"
        )
        tiles, links = self.tiles(members, "cluster", TILE_SHINGLES, self._percent, "shingles")
        joined = tiles.groupBy("cluster", "low", "high").applyInArrow(
            _joining(self._coordinates, self._matches, self._percent), "a long, b long"
        )
        return joined.union(links)

    def tiles(
        self, rows: DataFrame, key: str, unit: int, percent: int | None = None, *columns: str
    ) -> tuple[DataFrame, DataFrame]:
        """Tiles whose rows are to be compared, and the links (a, b) with centres of large groups.

        ``rows`` have class, signature, central, ``weight`` and their group's ``total`` weight. A
        group of up to ``unit`` is one tile. Of a larger one, the rows that are not linked to its
        most central class are compared with each other and with all the rest.
        """
        kept = (key, "class", "central", "signature", *columns)
        rows = write_shared(rows.select(*kept, "weight", "total"), "grouped")
        large = rows.where(F.col("total") > unit)
        first = F.max_by(
            F.struct("class", "signature", *columns), F.struct("central", -F.col("class"))
        )
        chunks = F.ceil(F.col("total") / unit).cast("int")
        centres = large.groupBy(key, chunks.alias("_chunks")).agg(first.alias("_centre"))
        # The centre goes to every chunk of its group.
        centres = centres.select(
            F.col(key).alias("_key"),
            F.col("_centre.class").alias("centre"),
            *(F.col(f"_centre.{c}").alias(f"centre_{c}") for c in ("signature", *columns)),
            F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_at"),
        )
        chunk = F.pmod(F.xxhash64("class"), chunks).cast("int")
        met = large.withColumn("_chunk", chunk).join(
            centres, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_at"))
        )
        compare = _against_centre(key, self._coordinates, self._matches, percent)
        sent = ("signature", "centre_signature", *(x for c in columns for x in (c, f"centre_{c}")))
        judged = met.select(key, "class", "centre", *sent).mapInArrow(
            compare, f"{key} long, class long, centre long, linked boolean"
        )
        judged = write_shared(judged, "judged")
        links = judged.where("linked and class <> centre").select(
            F.col("class").alias("a"), F.col("centre").alias("b")
        )
        weighed = large.join(judged.select(key, "class", "linked"), [key, "class"])
        # A centre agrees with itself, so it is linked.
        parts = weighed.groupBy(key).agg(
            F.ceil(F.sum(F.when(~F.col("linked"), F.col("weight"))) / unit).alias("_open"),
            F.ceil(F.sum(F.when(F.col("linked"), F.col("weight"))) / unit).alias("_settled"),
        )
        # Groups that their centre connects have no open rows, and no tiles.
        parts = parts.where("_open > 0").select(
            F.col(key).alias("_key"),
            F.col("_open").cast("int").alias("_open"),
            F.greatest("_settled", F.lit(1)).cast("int").alias("_settled"),
        )
        placed = weighed.join(parts, F.col(key) == F.col("_key"))
        spread = _tiles(placed, kept)
        one = rows.where(F.col("total") <= unit).select(
            *kept,
            F.lit(False).alias("settled"),
            F.lit(0).alias("low"),
            F.lit(0).alias("high"),
        )
        return one.unionByName(spread), links

    def sets(self, clustered: DataFrame) -> DataFrame:
        """(node, shingles) of the clustered classes, from the texts of their first documents."""
        nodes = clustered.select(F.col("class").alias("node"))
        # Both sides are shuffled at any size: how many classes are clustered grows with the data.
        found = self._texts.join(nodes.hint("merge"), self._texts.doc_id == nodes.node)
        return (
            found.select("node", "text")
            .distinct()
            .mapInArrow(_sets(self._size), "node long, shingles binary")
        )

    def components(self) -> DataFrame:
        posted = write_shared(self.posted(), "posted")
        return connected_components(write_shared(self.links(posted), "links"))


def _tiles(rows: DataFrame, kept: tuple[str, ...]) -> DataFrame:
    """The rows of groups in chunks by hash, and the chunks in pairs: (low, high) names a tile.

    Chunks of open rows meet each other, and those of linked (settled) rows, which have the numbers
    after them; chunks of settled rows do not meet.
    """
    hashed = F.xxhash64("class")
    own = F.when(
        F.col("linked"), F.col("_open") + F.pmod(hashed, F.col("_settled")).cast("int")
    ).otherwise(F.pmod(hashed, F.col("_open")).cast("int"))
    others = F.when(F.col("linked"), F.col("_open")).otherwise(F.col("_open") + F.col("_settled"))
    return (
        rows.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), others - 1)))
        .select(
            *kept,
            F.col("linked").alias("settled"),
            F.least("_own", "_other").alias("low"),
            F.greatest("_own", "_other").alias("high"),
        )
    )


def near_duplicates(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
) -> DataFrame:
    """Per row doc_id, n_shingles, component_id and kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of shingles of
    ``size`` words (see ``Shingler``). ``component_id`` is the smallest doc_id reachable over links,
    and ``kept`` says that it is the row's own. Texts that are null, empty or without words have no
    shingles and are linked with nothing. Rows without doc_id take no part: their component is null
    and they are kept. Rows that repeat a doc_id with the same text share its component and are all
    kept; with other texts they count as versions of the document, and where both are the least of
    their groups these become one. An empty table gives no rows; only doc_id and text are read.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    sketched = write_shared(
        texts.mapInArrow(
            _sketch(size, coordinates),
            "doc_id long, n_shingles long, set_digest binary, signature binary",
        ),
        "sketches",
    )
    usable = sketched.where("n_shingles > 0 and doc_id is not null")
    classes = write_shared(
        usable.groupBy("n_shingles", "set_digest").agg(
            F.min("doc_id").alias("class"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    search = _Search(texts, classes, size, percent, coordinates)
    components = search.components()
    groups = classes.join(components, F.col("class") == F.col("node"), "left").select(
        F.col("n_shingles").alias("_n"),
        F.col("set_digest").alias("_digest"),
        F.coalesce("component", "class").alias("_component"),
    )
    same = (F.col("n_shingles") == F.col("_n")) & (F.col("set_digest") == F.col("_digest"))
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return sketched.join(groups, same, "left").select(
        "doc_id",
        "n_shingles",
        found.alias("component_id"),
        F.coalesce(found == F.col("doc_id"), F.lit(True)).alias("kept"),
    )

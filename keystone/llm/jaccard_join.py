"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the hashes of its distinct word shingles; equal sets
collapse to one node first. Tokens are ordered from seldom to common: by the
class (power of two) of their count in a sketch of fixed size over all
documents, then by their hash. Any one order gives the same result; the sketch
only decides how few sets share a prefix. A set of n that may differ from a
partner in t tokens keeps a prefix of t + 1 tokens, extended by what
combinations need: a token of few sets (rare) is indexed by itself; a token of
``FREQUENT`` or more sets is indexed in pairs with the other frequent tokens of
its partition of the prefix. A partition with l frequent tokens then counts
l - 1 towards the t + 1, so a linked pair shares a rare token or a pair. Sets
with over t rare tokens in the prefix meet each other by those alone, and must
share as many as that guarantees.

Of two sets, the one whose prefix ends first in the order has all of its prefix
tokens that the other holds in the other's prefix too. So its rare tokens, and its
prefix tokens that no other prefix holds, bound what the pair can share; a pair that
cannot reach the threshold is not compared. All other candidates are verified exactly.

Long posting lists (copies with small changes, boilerplate) are not paired out.
Each list is compared with one pivot first, the set with the fewest tokens of its own
(the text that copies were made from). Lists that this leaves in several components are
grouped by pivot, and each group is described by what its sets differ in from the tokens
that most of them hold. Two sets that differ in few enough tokens, taken together, are
linked, and so is the set that differs least with both; any other linked pair
has to share differing tokens, so only lists of these, with prefixes of their own, make
candidates. The links are the same as if each list were paired out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import discard, mix, scratch_table, utf8, window_hashes, word_hashes
from keystone.llm.components import connected_components
from keystone.llm.passages import NO_ID

#: Distinct sets from which a token counts as frequent.
FREQUENT = 16
#: One partition of the frequent tokens for each so many tokens of a set.
PARTITION = 32
#: Pivots that each list is compared with before its sets are told apart by what they differ in.
PIVOTS = (1,)
#: Counters of the sketch and the chunks in which they are summed. 4 MB of classes go to each task,
#: whatever the input; groups of fewer copies than there are tokens for each counter look like noise.
COUNTERS = 1 << 22
CHUNKS = 64
#: Tokens of a partition that are held before they are counted, beside one text.
HELD = 1 << 18


def differing(n, percent: int):
    """Most tokens of a set of ``n`` that a linked set can lack."""
    return n - -(-n * percent // 100)


def partitions(band: int) -> int:
    return max(1, (1 << band) // PARTITION)


def bands(n: int, percent: int) -> list[int]:
    """Powers of two that ``n`` and the sizes it can link with lie in (each is n's own or next to it)."""
    low, high = -(-n * percent // 100), n * 100 // percent
    return list(range(low.bit_length() - 1, high.bit_length()))


def prefix_length(n: int, percent: int) -> int:
    """Length that holds t + 1 counted tokens for any of the set's bands; 0 if only an equal set can link."""
    if n * (100 - percent) < percent:
        return 0
    return min(n, differing(n, percent) + 1 + partitions(bands(n, percent)[-1]))


def shingle_set(text, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle, without words none."""
    w = word_hashes(utf8(text).lower())
    if not len(w):
        return w
    return np.unique(window_hashes(w, words) if len(w) >= words else window_hashes(w, len(w)) ^ np.uint64(len(w)))


def set_id(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _token_counts(words: int):
    """(chunk, counts): how often tokens fall on each counter in a partition of texts."""
    def run(batches):
        total = np.zeros(COUNTERS, dtype=np.int64)
        held, size = [], 0

        def add():
            nonlocal held, size
            if held:            # in place: a second set of counters would double what a worker holds
                np.add.at(total, (np.concatenate(held) % np.uint64(COUNTERS)).view(np.int64), 1)
            held, size = [], 0

        for pdf in batches:
            for text in pdf["text"]:
                w = word_hashes(utf8(text).lower())
                if len(w) >= words:
                    held.append(window_hashes(w, words))
                    size += len(w)
                    if size > HELD:
                        add()
        add()
        if total.any():
            yield pd.DataFrame({"chunk": np.arange(CHUNKS, dtype=np.int32),
                                "counts": [zlib.compress(c.tobytes(), 1) for c in np.split(total, CHUNKS)]})
    return run


def _classes(batches):
    """Chunks of counts to one row (chunk, class of each counter) a chunk."""
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for chunk, counts in zip(pdf["chunk"].tolist(), pdf["counts"], strict=True):
            counts = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            total[chunk] = total[chunk] + counts if chunk in total else counts
    for chunk, counts in total.items():
        yield pd.DataFrame({"chunk": [chunk], "classes": [np.frexp(counts.astype(float))[1].astype(np.uint8).tobytes()]})


def token_classes(texts: DataFrame, words: int) -> bytes:
    """Class (binary digits of the count) of each counter over all texts: ``COUNTERS`` bytes."""
    chunks = texts.select("text").mapInPandas(_token_counts(words), "chunk int, counts binary") \
        .repartition("chunk").mapInPandas(_classes, "chunk int, classes binary").collect()  # CHUNKS rows at most
    out = bytearray(COUNTERS)
    for row in chunks:
        at = row["chunk"] * (COUNTERS // CHUNKS)
        out[at:at + COUNTERS // CHUNKS] = row["classes"]
    return bytes(out)


def _sets(words: int, percent: int, classes):
    """``classes``: broadcast of ``token_classes``."""
    def run(batches):
        of = np.frombuffer(classes.value, dtype=np.uint8)
        for pdf in batches:
            n, sid, prefix, last = [], [], [], []
            for text in pdf["text"]:
                u = shingle_set(text, words)
                n.append(len(u))
                sid.append(set_id(u) if len(u) else None)
                length = prefix_length(len(u), percent)
                kind = of[(u % np.uint64(COUNTERS)).astype(np.int64)] if length else of[:0]
                order = np.argsort(kind, kind="stable")[:length]
                prefix.append(u[order].view(np.int64))
                last.append((int(kind[order[-1]]) << 56) + (int(u[order[-1]]) >> 8) if length else 0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "h": pdf["h"], "n": n, "sid": sid, "prefix": prefix, "last": last})
    return run


def _full(words: int):
    def run(batches):
        for pdf in batches:
            out = [(node, len(u), u.tobytes()) for node, sid, text in zip(pdf["node"], pdf["sid"], pdf["text"], strict=True)
                   if set_id(u := shingle_set(text, words)) == bytes(sid)]
            yield pd.DataFrame(out, columns=["node", "n", "tokens"])
    return run


def _combinations(percent: int):
    """(sig, node, n): pairs of frequent tokens within a partition, for each band."""
    def run(batches):
        for pdf in batches:
            out = []
            for node, n, tokens in zip(pdf["node"], pdf["n"], pdf["tokens"], strict=True):
                t = np.sort(np.array(tokens, dtype=np.int64).view(np.uint64))
                for band in bands(int(n), percent):
                    part = (mix(t ^ np.uint64(band + 1)) % np.uint64(partitions(band))).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    u, part = t[order], part[order]
                    for d in range(1, len(u)):  # tokens d places apart in one partition
                        both = part[d:] == part[:-d]
                        if not both.any():
                            break
                        sig = mix(u[:-d][both] * np.uint64(3) + mix(u[d:][both] + np.uint64(band)))
                        out.append((sig.view(np.int64), np.full(len(sig), node), np.full(len(sig), n)))
            yield pd.DataFrame(dict(zip(("sig", "node", "n"), map(np.concatenate, zip(*out, strict=True)), strict=True))
                               if out else {c: np.zeros(0, np.int64) for c in ("sig", "node", "n")})
    return run


def _linked(percent: int):
    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["x"], pdf["y"], strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[np.array(keep, dtype=bool), ["a", "b"]]
    return run


def jaccard_links(documents: DataFrame, words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sets, components): sets (k, h, doc_id, n, sid) one row a document, components (sid, root) by node.

    ``root`` is the same for all sets that links connect.
    """
    if not 60 <= percent < 100:
        raise ValueError("a similarity of 60 to 99 percent")
    texts = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"),
                             F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    classes = documents.sparkSession.sparkContext.broadcast(token_classes(texts, words))
    sets = scratch_table(texts.select("doc_id", "h", "text").mapInPandas(
        _sets(words, percent, classes), "doc_id string, h long, n long, sid binary, prefix array<long>, last long")
                         .withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), "shingle-sets")
    nodes = scratch_table(sets.where("sid is not null").groupBy("sid").agg(F.min(F.struct("k", "h")).alias("of"), *[F.first(c).alias(c) for c in ("n", "prefix", "last")])
                          .withColumn("node", F.monotonically_increasing_id()), "shingle-nodes")
    entries = nodes.where("size(prefix) > 0").select("node", "n", "last", F.size("prefix").alias("length"), F.explode("prefix").alias("token"))
    counts = entries.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = scratch_table(entries.join(counts, "token"), "shared-tokens")
    frequent = shared.where(F.col("sets") >= FREQUENT)

    # What holds towards nodes whose prefix ends later. ``sure``: rare tokens that the node shares with each linked one, at least;
    # heavy nodes have none for sure. ``most``: tokens that it can share, as no other prefix holds the rest
    t = F.col("n") - F.ceil(F.col("n") * percent / 100)
    sure = scratch_table(shared.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "last", "length")], F.count("*").alias("shared"),
                                                    F.count_if(F.col("sets") >= FREQUENT).alias("frequent"))
                         .select("node", "n", "last", (F.col("length") - F.col("frequent") - t).alias("sure"),
                                 (F.col("n") - F.col("length") + F.col("shared")).alias("most")), "shingle-sure")

    def reach(a: str, b: str):
        """What the node whose prefix ends first can share is enough (if both end alike: what either can)."""
        most = F.when(F.col("last" + a) < F.col("last" + b), F.col("most" + a)).when(F.col("last" + a) > F.col("last" + b), F.col("most" + b)) \
            .otherwise(F.greatest("most" + a, "most" + b))
        return (most * (100 + percent) >= (F.col("n" + a) + F.col("n" + b)) * percent) & (F.least("n" + a, "n" + b) * 100 >= F.greatest("n" + a, "n" + b) * percent)

    # rare lists hold fewer than FREQUENT nodes: all pairs of them, of sizes that can link
    lists = shared.where(F.col("sets") < FREQUENT).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("l"))
    fits = lambda x: lambda y: y["n"] * percent <= x["n"] * 100
    pairs = F.flatten(F.transform("l", lambda x, i: F.transform(
        F.filter(F.slice("l", i + 2, F.size("l")), fits(x)), lambda y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")))))
    rare = lists.select(F.explode(pairs).alias("p")).select("p.*").groupBy("a", "b").agg(F.count("*").alias("common"))
    sa, sb = (sure.select(F.col("node").alias(c), *[F.col(v).alias(v + c) for v in ("n", "last", "sure", "most")]) for c in "ab")
    enough = F.when(F.col("lasta") < F.col("lastb"), F.col("surea")).when(F.col("lasta") > F.col("lastb"), F.col("sureb")).otherwise(F.least("surea", "sureb"))
    rare = scratch_table(rare.join(sa, "a").join(sb, "b").where((F.col("common") >= enough) & reach("a", "b")).select("a", "b"), "rare-pairs")

    # a pair can depend on combinations if the node whose prefix ends first is heavy
    of_node = frequent.groupBy("node").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens")).where("size(tokens) > 1")
    combos = scratch_table(of_node.mapInPandas(_combinations(percent), "sig long, node long, n long")
                           .join(sure.select("node", "last", "most", (F.col("sure") < 1).alias("heavy")), "node"), "combinations")
    useful = combos.groupBy("sig").agg(F.count("*").alias("c"), F.max("heavy").alias("any")).where("c > 1 and any").select("sig")
    combos = _instead(combos, combos.join(useful, "sig", "left_semi").withColumn("root", F.col("node")), "shared-combinations")
    discard(shared)
    discard(sure)

    wanted = rare.select(F.explode(F.array("a", "b")).alias("node")).union(combos.select("node")).distinct()
    # the text that a node stands for, by id and hash: null and repeated ids are no key, rows alike in both are read once
    held = nodes.join(wanted, "node", "left_semi").select("node", "of.k", "of.h", "sid")
    full = scratch_table(texts.select("k", "h", "text").join(held, ["k", "h"]).dropDuplicates(["k", "h"]).mapInPandas(_full(words), "node long, n long, tokens binary")
                         , "full-sets")

    def verified(candidates: DataFrame) -> DataFrame:
        x, y = (full.select(F.col("node").alias(c), F.col("tokens").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        return scratch_table(candidates.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInPandas(_linked(percent), "a long, b long"), "links")

    # First round: one partner for each node and a pivot for each list, the one with the most tokens in common with others.
    # Second: what that has not connected of the rare pairs, and what the lists have left to compare.
    first = rare.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    of_list = ["node", "n", "last", "most"]
    pivots = combos.where("heavy").groupBy("sig").agg(F.min(F.struct((F.col("n") - F.col("most")).alias("own"), F.xxhash64("node").alias("h"), *of_list)).alias("p")) \
        .select("sig", *[F.col(f"p.{c}").alias(c + "b") for c in of_list])
    combos = _instead(combos, combos.join(pivots, "sig"), "shared-combinations")
    roots, compared, groups = None, None, []
    if PIVOTS:
        met = combos.where((F.col("node") != F.col("nodeb")) & reach("", "b")) \
            .select(F.least("node", "nodeb").alias("a"), F.greatest("node", "nodeb").alias("b"))
        compared = scratch_table(met.unionByName(first).distinct(), "pivot-pairs")
        if not compared.isEmpty():
            roots = _merge(None, verified(compared))
    here = combos.drop("root") if roots is None else combos.drop("root").join(roots, "node", "left")
    here = here.withColumn("root", F.col("node") if roots is None else F.coalesce("root", "node"))
    mixed = here.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    members = scratch_table(here.join(mixed, "sig", "left_semi").select(F.col("nodeb").alias("pivot"), *of_list, "heavy", "root").distinct(), "list-members")
    new = rare if roots is None else _apart(rare, roots)
    links = None
    if not members.isEmpty():
        certain, candidates, groups = _differing(members, full, percent, reach)
        new = new.unionByName(candidates)
        links = certain
    new = new.distinct()
    if compared is not None:
        new = new.join(compared, ["a", "b"], "left_anti")
    new = scratch_table(new, "pivot-pairs")
    if not new.isEmpty():
        found = verified(new)
        links = found if links is None else _instead(found, found.unionByName(links), "links")
    elif links is not None:
        links = scratch_table(links, "links")
    if links is not None and not links.isEmpty():
        roots = _merge(roots, links)
    compared = [new] if compared is None else [compared, new]
    for table in (members, *groups):
        discard(table)
    for table in (rare, combos, full, *compared):
        discard(table)
    if roots is None:
        roots = nodes.select("node", F.col("node").alias("root")).limit(0)
    return sets.select("k", "h", "doc_id", "n", "sid"), nodes.select("sid", "node").join(roots, "node", "left") \
        .select("sid", F.coalesce("root", "node").alias("root"))


def _longs(batches):
    for pdf in batches:
        yield pd.DataFrame({"node": pdf["node"], "held": [np.frombuffer(x, dtype=np.int64) for x in pdf["tokens"]]})


def _differing(members: DataFrame, full: DataFrame, percent: int, reach) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(links, candidates, scratch tables) of the groups of ``members`` (pivot, node, n, last, most, heavy, root).

    D(x) are the tokens in which x differs from those that more than half of its group hold, and
    f(x) = (100 + percent) |D(x)| - (100 - percent) n(x). Sets a and b link when
    f(a) + f(b) <= 2 (100 + percent) |D(a) & D(b)|. If the left side is not positive, both
    link with the set of least f, too; these links need no check. Else the pair shares a token, and as many as the
    least f leaves open at least, so prefixes of D, seldom tokens first, meet. Candidates are pairs of different roots.
    """
    one, sizes = 2 * (100 + percent), members.groupBy("pivot").agg(F.count("*").alias("size")).where("size > 1")
    tokens = members.join(sizes, "pivot").select("pivot", "node", "size").join(full.select("node", "tokens").mapInPandas(_longs, "node long, held array<long>"), "node")
    tokens = scratch_table(tokens, "list-tokens")
    common = tokens.select("pivot", "size", F.explode("held").alias("token")).groupBy("pivot", "token").agg(F.count("*").alias("c"), F.first("size").alias("size")) \
        .where("2 * c > size").groupBy("pivot").agg(F.collect_list("token").alias("common"))  # at most twice a set's mean size
    common = tokens.join(common, "pivot", "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>")))
    differ = common.select("pivot", "node", F.concat(F.array_except("held", "common"), F.array_except("common", "held")).alias("d"))
    differ = members.join(differ, ["pivot", "node"]).withColumn("f", (100 + percent) * F.size("d") - (100 - percent) * F.col("n"))
    differ = scratch_table(differ, "list-differences")
    least = differ.groupBy("pivot").agg(F.min(F.struct("f", "node")).alias("least"))
    differ_least = differ.drop("d").join(least, "pivot")
    links = differ_least.where((F.col("f") + F.col("least.f") <= 0) & (F.col("node") != F.col("least.node"))) \
        .select(F.least("node", "least.node").alias("a"), F.greatest("node", "least.node").alias("b"))

    each = differ.select("pivot", "node", F.explode("d").alias("token"))
    shared = each.join(each.groupBy("pivot", "token").agg(F.count("*").alias("sets")).where("sets > 1"), ["pivot", "token"]) \
        .groupBy("pivot", "node").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("s"))
    needed = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("least.f")) / one))
    length = F.greatest(F.size("s") - needed + 1, F.lit(0)).cast("int")
    entries = differ_least.join(shared, ["pivot", "node"]).withColumn("many", F.size("s")) \
        .select("*", F.posexplode(F.slice("s", F.lit(1), length)).alias("at", "t")) \
        .select("pivot", F.col("t.token").alias("token"), "node", "n", "last", "most", "heavy", "root", "f", (F.col("many") - F.col("at")).alias("rest"))
    entries = scratch_table(entries, "list-entries")
    x, y = (entries.select("pivot", "token", *[F.col(v).alias(v + c) for v in entries.columns[2:]]) for c in "ab")
    ends_first = (F.col("heavya") & (F.col("lasta") <= F.col("lastb"))) | (F.col("heavyb") & (F.col("lastb") <= F.col("lasta")))
    # at the first token that a linked pair shares, what follows in both can still make up for f
    pairs = x.join(y, ["pivot", "token"]).where((F.col("nodea") < F.col("nodeb")) & (F.col("roota") != F.col("rootb")) & reach("a", "b") & ends_first
                                                & (one * F.least("resta", "restb") >= F.col("fa") + F.col("fb")))
    return links, pairs.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")), [tokens, differ, entries]


def _instead(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """``new`` as a scratch table, in place of the one it was made from."""
    out = scratch_table(new, name)
    discard(old)
    return out


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose nodes are not yet in one component."""
    ra, rb = (roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
    return pairs.join(ra, "a", "left").join(rb, "b", "left") \
        .where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _merge(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components (node, root) of earlier components and new links."""
    edges = links.select("a", "b") if roots is None else links.select("a", "b").unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    out = scratch_table(connected_components(edges).withColumnRenamed("component", "root"), "jaccard-roots")
    for table in (links, roots):
        if table is not None:
            discard(table)
    return out


def jaccard_components(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` (doc_id, text) to (doc_id, n_shingles, component_id), one row each.

    A-Z are lowered; words are ``[^\\x20\\x09-\\x0D]+`` and a set holds the distinct
    shingles of ``words`` words, the whole sequence if there are fewer. Documents
    link when 100 * common >= ``percent`` * united. Null texts and texts without words
    have an empty set and link with nothing. component_id is the least doc_id
    that links reach, the document's own included (null ids are left out of it, and
    null if there is no other). Rows that repeat an id are documents of their own. Other
    columns are ignored; an empty table gives an empty result.
    """
    sets, components = jaccard_links(documents, words, percent)
    joined = sets.join(components, "sid", "left").withColumn("doc_id", F.col("doc_id").cast("long"))
    least = joined.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return joined.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each_group(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` without all but one row of each group of linked documents.

    Kept is the row with the least doc_id (null first; ties by a hash of the text).
    Rows alike in id and text count as one document. Documents without words
    stay. Columns are unchanged.
    """
    sets, components = jaccard_links(documents, words, percent)
    found = sets.join(components, "sid", "left").select("k", "h", "root")
    # the least of each group by a sum before the shuffle, not by a window over the group
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("k", "h")).alias("f")).select("f.*")
    keep = first.unionByName(found.where("root is null").select("k", "h")).distinct().select(F.col("k").alias("__k"), F.col("h").alias("__h"))
    keyed = documents.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__h": F.xxhash64("text")})
    return keyed.join(keep, ["__k", "__h"], "left_semi").dropDuplicates(["__k", "__h"]).drop("__k", "__h")

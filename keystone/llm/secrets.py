"""Secret scans over whole texts with DataFrame functions only.

Base kinds are leftmost non-overlapping matches. To these the corpus-wide
ownership frequency adds spans of kind ``live``: generic credential-shaped
tokens are hashed, and their hashes aggregated over the corpus by distinct
repositories (documents) and owners (sources). Both counts are returned for each
token and decide whether it is a widely copied example or live-looking and
added: op3 and the pipeline set bounds for both, by default owners alone decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keystone.llm.common import scratch_table
from keystone.llm.passages import other_columns

#: The base patterns. Kinds are numbered in this order.
KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
#: Runs that are too short for a kind can't hold a longer one, so the least length is part of the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Generic credentials: 20 or more token characters with a digit, a small and a capital letter.
GENERIC = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[a-z0-9+/_=-]*[A-Z])(?=[A-Z0-9+/_=-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"


def _found(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of the matches, in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so starts
    are running sums of lengths.
    """
    between = F.transform(F.split(text, pattern, -1), F.length)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        end = begin + F.length(pair["value"])
        one = F.struct(pair["value"].alias("value"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    pairs = F.zip_with(F.slice(between, 1, F.size(values)), values,
                       lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(F.size(values) > 0, F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(empty)


def _kind(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                                                 s["end"].alias("end"), s["value"].alias("value")))


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find_secrets(documents: DataFrame, owner: str = "source", max_owners: int = 1, least_documents: int = 1,
                 max_documents: int | None = None, carry_row: bool = False) -> DataFrame:
    """One row per document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, all_spans, copies).

    Null and empty texts hold no secrets (base_sha256 of the empty string, empty
    spans). Spans are in code points, end exclusive. ``all_spans`` is the array of
    (start, kind number, end, value). ``n_live`` counts added spans and
    ``n_example`` generic tokens left out as examples: those that over ``max_owners``
    owners hold in ``least_documents`` documents or more, and, with ``max_documents``,
    those in more documents than that, whoever owns them. Documents are distinct
    ids of an owner, however often one holds the token; a null owner or id counts as one
    of its own. ``copies`` is the array of (start, end, n_documents, n_owners) of all
    generic tokens, by start. Generic tokens that touch a base span add nothing. With ``carry_row`` the text and a struct ``row`` of the
    other columns follow. Repeated rows give repeated results, other columns
    are ignored, and an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_found(text, ASSIGN),
                      lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_VALUE)
    base = F.array_sort(F.concat(_kind(assign, "assign"), _kind(_found(text, ACCESS), "access"), _kind(_found(text, HEX), "hex")))
    generic = _kind(_found(text, GENERIC), "live")
    extra = [other_columns(documents), "text"] if carry_row else []
    scanned = documents.select(
        "doc_id", *extra, F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), base.alias("base"), generic.alias("generic"))
    apart = F.filter("generic", lambda g: ~F.exists("base", lambda b: (b["start"] < g["end"]) & (g["start"] < b["end"])))
    rows = scratch_table(scanned.withColumn("generic", apart).withColumn("uid", F.monotonically_increasing_id()), "secret-spans")

    found = rows.select("uid", "doc_id", "owner", F.explode("generic").alias("g")) \
        .withColumn("hash", F.sha2(F.col("g.value"), 256))
    # (hash, owner, document) first: a value copied a million times is a few rows when its owners are counted
    counts = found.groupBy("hash", "owner", "doc_id").agg(F.lit(1).alias("one")) \
        .groupBy("hash", "owner").agg(F.sum("one").alias("documents")) \
        .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("documents").alias("n_documents"))
    example = (F.col("n_owners") > max_owners) & (F.col("n_documents") >= least_documents)
    if max_documents is not None:
        example |= F.col("n_documents") > max_documents
    copy = F.struct(F.col("g.start").alias("start"), F.col("g.end").alias("end"), "n_documents", "n_owners")
    judged = found.join(counts, "hash").groupBy("uid").agg(
        F.collect_list(F.when(~example, F.col("g"))).alias("live"),
        F.count_if(example).alias("n_example"), F.array_sort(F.collect_list(copy)).alias("copies"))
    out = rows.join(judged, "uid", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    kinds = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    every = F.array_sort(F.concat("base", F.coalesce("live", none)))
    return out.select("doc_id", *kinds, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"),
                      F.size(F.coalesce("live", none)).cast("long").alias("n_live"),
                      F.coalesce("n_example", F.lit(0)).alias("n_example"), every.alias("all_spans"),
                      F.coalesce("copies", F.array().cast("array<struct<start:int,end:int,n_documents:bigint,n_owners:bigint>>")).alias("copies"),
                      *(["row", "text"] if carry_row else []))

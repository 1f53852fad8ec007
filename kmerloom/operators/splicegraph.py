"""Splice graph: chained exons, exons merged by shared end k-mers, relabelled edges."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.codes import _CODE, _packed, code_names, decode, widths, windows_of
from kmerloom.operators.components import connected_components
from kmerloom.operators.superkmers import BUCKETS, _bucket, _mixed
from kmerloom.storage import global_rank, materialize

#: Length and number of the k-mers at each end of an exon, and the span of lengths that counts as similar.
END_K, END_N, SIMILAR = 30, 10, 5
#: Ends whose k-mers are sent together.
BUFFER = 1 << 17


def parse_headers(records: DataFrame) -> DataFrame:
    """(rec_no, name, exon, start, end, seq) from headers id_start_end; underscores inside the id vanish."""
    parts = F.split(F.col("id"), "_")
    size = F.size(parts)
    name = F.array_join(F.slice(parts, F.lit(1), F.greatest(size - 2, F.lit(0))), "")
    start, end = F.get(parts, size - 2), F.get(parts, size - 1)
    return records.select(
        "rec_no", name.alias("name"), F.concat_ws("_", name, start, end).alias("exon"),
        start.try_cast("int").alias("start"), end.try_cast("int").alias("end"), "seq",
    )


def exon_blocks(exons: DataFrame) -> DataFrame:
    """``exons`` with next_exon, is_first, is_last and terminal, of records that stand next to one of their name.

    ``rec_no`` counts the records without gaps, so a neighbour is found by a join on it
    and no window runs over the whole table.
    """
    side = exons.select("rec_no", "name", "exon")
    before = side.select((F.col("rec_no") + 1).alias("rec_no"), F.col("name").alias("_before"))
    after = side.select((F.col("rec_no") - 1).alias("rec_no"), F.col("name").alias("_after"), F.col("exon").alias("_next"))
    same_b, same_a = F.col("_before").eqNullSafe(F.col("name")), F.col("_after").eqNullSafe(F.col("name"))
    return (
        exons.join(before, "rec_no", "left")
        .join(after, "rec_no", "left")
        .withColumns({"is_first": ~same_b, "is_last": ~same_a, "next_exon": F.when(same_a, F.col("_next"))})
        .filter(~(F.col("is_first") & F.col("is_last")))
        .withColumn("terminal", F.col("is_first") | F.col("is_last"))
        .drop("_before", "_after", "_next")
    )


def chain_edges(blocks: DataFrame) -> DataFrame:
    """(line_no, src, dst): each exon and its successor; of records that share an exon name the last counts."""
    linked = blocks.filter(F.col("next_exon").isNotNull())
    return linked.groupBy(F.col("exon").alias("src")).agg(F.max_by("next_exon", "rec_no").alias("dst"), F.max("rec_no").alias("line_no")).select("line_no", "src", "dst")


def end_index(blocks: DataFrame, k: int = END_K, n: int = END_N) -> DataFrame:
    """(side, kmer, exon): the first n k-mers of exons that are not first, the last n of those that are not last."""
    size = F.char_length("seq")
    places = F.sequence(F.lit(0), F.lit(n - 1))
    long_ = blocks.filter(size >= k + n - 1)
    start = F.transform(places, lambda i: F.substring(F.col("seq"), i + 1, F.lit(k)))
    end = F.transform(places, lambda i: F.substring(F.col("seq"), size - k - i + 1, F.lit(k)))
    return long_.filter(~F.col("is_first")).select(F.lit("start").alias("side"), F.explode(start).alias("kmer"), "exon").unionByName(
        long_.filter(~F.col("is_last")).select(F.lit("end").alias("side"), F.explode(end).alias("kmer"), "exon")
    )


def end_bases(records: DataFrame, number: str, k: int = END_K, n: int = END_N) -> DataFrame:
    """(number, start, bases): the bases that the first n k-mers of exons that are not first have, and the last n of those that are not last."""
    wide = k + n - 1
    both = F.array(
        F.struct(F.lit(True).alias("start"), F.when(~F.col("is_first"), F.substring("seq", 1, wide)).alias("bases")),
        F.struct(F.lit(False).alias("start"), F.when(~F.col("is_last"), F.substring(F.col("seq"), F.char_length("seq") - wide + 1, F.lit(wide))).alias("bases")),
    )
    own = records.filter(F.char_length("seq") >= wide).select(F.col(number).cast("bigint").alias("number"), F.explode(both).alias("e"))
    return own.select("number", "e.start", "e.bases").filter("bases is not null")


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order by all columns, and which of them differ from the one before in a column but the last."""
    order = np.lexsort(columns[::-1])
    opens = np.zeros(len(order), bool)
    opens[:1] = True
    for c in columns[:-1]:
        opens[1:] |= np.diff(c[order]) != 0
    return order, opens


def _once_each(links: np.ndarray) -> np.ndarray:
    """The distinct columns of (u, v), in order."""
    links = links[:, np.lexsort(links[::-1])]
    first = np.ones(links.shape[1], bool)
    first[1:] = np.any(np.diff(links, axis=1) != 0, axis=0)
    return links[:, first]


def _stars(keys: list[np.ndarray], numbers: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys, the smallest number of each, links): numbers of a key hang on its smallest one; each link (u, v) once."""
    order, opens = _runs([*keys, numbers])
    first = np.flatnonzero(opens)
    least = numbers[order[first]]
    links = np.stack((numbers[order], np.repeat(least, np.diff(np.concatenate((first, [len(order)]))))))
    return [c[order[first]] for c in keys], least, _once_each(links[:, links[0] != links[1]])


def _sides(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, dict[str, list[int]]]]:
    """About BUFFER ends of (number, start, bases) at a time: (codes, numbers) of their k-mers, the lowest bit of the first code being the side; numbers by k-mers with other letters, the side before them."""

    def one(held: list[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray, dict[str, list[int]]]:
        table = pa.Table.from_batches(held).combine_chunks()
        number, start = table["number"].to_numpy(), table["start"].to_numpy().astype(np.int64)
        codes, rows, other = [[] for _ in widths(k)], [], {}
        texts = table["bases"].combine_chunks()
        for part, row, _, inside, clean in windows_of(texts, k):
            own = inside & clean
            at, digits = 0, _CODE[part] & 3
            for j, w in enumerate(widths(k)):
                codes[j].append(_packed(digits, w)[at : at + len(own)][own])
                at += w
            rows.append(row[own])
        for i in np.flatnonzero(pc.match_substring_regex(texts, "[^ACGT]").to_numpy(zero_copy_only=False)):
            text = texts[i].as_py()
            for kmer in (text[x : x + k] for x in range(len(text) - k + 1)):
                if kmer.strip("ACGT"):
                    other.setdefault(f"{start[i]}{kmer}", []).append(int(number[i]))
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        words = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in codes]
        words[0] = words[0] << 1 | start[row]
        return words, number[row], other

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BUFFER:
            yield one(held)
            held, size = [], 0
    if size:
        yield one(held)


def _dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """The columns' bytes by bucket."""
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    parts = [np.split(c[order], first[1:]) for c in columns]
    for i, at in enumerate(first):
        yield int(bucket[order[at]]), [p[i].tobytes() for p in parts]


def _by_bucket(ends: DataFrame, k: int, stars: bool) -> DataFrame:
    """(bucket, kind, text, data, numbers): k-mers of ``ends`` with the numbers that have them, those of one k-mer in one bucket, packed.

    With ``stars`` numbers of a k-mer that meet in a task are linked there, and only the smallest is sent: a k-mer of many exons is no large group.
    """
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("data", pa.list_(pa.binary())), ("numbers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, numbers, other in _sides(batches, k):
            out = []
            if stars:
                codes, numbers, links = _stars(codes, numbers)
                out += [(b, "links", None, [u], v) for b, (u, v) in _dealt(links[0] % BUCKETS, list(links))]
            else:
                order, opens = _runs([*codes, numbers, np.zeros(len(numbers), np.int8)])
                codes, numbers = [c[order[opens]] for c in codes], numbers[order[opens]]
            hashed = np.bitwise_xor.reduce([c.view(np.uint64) * np.uint64(2 * j + 1) for j, c in enumerate(codes)])
            out += [(b, "codes", None, words, own) for b, (*words, own) in _dealt(_bucket(_mixed(hashed)), [*codes, numbers])]
            out += [(zlib.crc32(text.encode()) % BUCKETS, "text", text, [], np.unique(own).tobytes()) for text, own in other.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema)

    return ends.select("number", "start", "bases").mapInArrow(run, "bucket int, kind string, text string, data array<binary>, numbers binary")


def _met(table: pa.Table, k: int) -> tuple[list[np.ndarray], np.ndarray, dict[str, np.ndarray], list[np.ndarray]]:
    """(codes, numbers, numbers by k-mers with other letters, links) of a bucket's rows."""
    ints = lambda parts: np.frombuffer(b"".join(parts), np.int64)
    rows = [table.filter(pc.equal(table["kind"], kind)).select(["text", "data", "numbers"]).to_pylist() for kind in ("codes", "text", "links")]
    codes = [ints(r["data"][j] for r in rows[0]) for j in range(len(widths(k)))]
    text: dict[str, list[bytes]] = {}
    for r in rows[1]:
        text.setdefault(r["text"], []).append(r["numbers"])
    links = [np.stack((ints(r["data"][0] for r in rows[2]), ints(r["numbers"] for r in rows[2])))]
    return codes, ints(r["numbers"] for r in rows[0]), {t: np.unique(ints(n)) for t, n in text.items()}, links


def exon_links(ends: DataFrame, k: int = END_K) -> DataFrame:
    """(u, v): links that join all numbers of a shared k-mer of ``end_bases``; they grow with its rows and not with pairs, and may repeat."""

    def own(table: pa.Table) -> pa.Table:
        codes, numbers, text, links = _met(table, k)
        links.append(_stars(codes, numbers)[2])
        links += [np.stack((n[1:], np.full(len(n) - 1, n[0]))) for n in text.values()]
        u, v = _once_each(np.concatenate(links, axis=1))
        return pa.table([u, v], names=["u", "v"])

    return _by_bucket(ends, k, True).groupBy("bucket").applyInArrow(own, "u bigint, v bigint")


def shared_numbers(ends: DataFrame, k: int = END_K) -> DataFrame:
    """(side, kmer, exons, first): how many numbers share a k-mer of ``end_bases``, and the smallest one."""
    names = code_names(k)

    def own(table: pa.Table) -> pa.Table:
        codes, numbers, text, _ = _met(table, k)
        order, opens = _runs([*codes, numbers, np.zeros(len(numbers), np.int8)])
        order = order[opens]  # each number of a k-mer once
        codes, numbers = [c[order] for c in codes], numbers[order]
        first = np.flatnonzero(_runs([*codes, numbers])[1])
        many = np.diff(np.concatenate((first, [len(numbers)])))
        first, many = first[many > 1], many[many > 1]
        start = (codes[0][first] & 1).astype(bool)
        words = [codes[0][first] >> 1, *(c[first] for c in codes[1:])]
        out = [pa.table([start, *words, pa.nulls(len(first), pa.string()), many, numbers[first]], names=["start", *names, "text", "exons", "first"])]
        more = [(t[0] == "1", *[None] * len(names), t[1:], len(n), int(n[0])) for t, n in text.items() if len(n) > 1]
        return pa.concat_tables([*out, pa.Table.from_pylist([dict(zip(out[0].column_names, r, strict=True)) for r in more], out[0].schema)])

    found = _by_bucket(ends, k, False).groupBy("bucket").applyInArrow(own, f"start boolean, {', '.join(f'{c} bigint' for c in names)}, text string, exons bigint, first bigint")
    return found.select(F.when(F.col("start"), "start").otherwise("end").alias("side"), F.coalesce("text", decode(k)).alias("kmer"), "exons", "first")


def shared_groups(blocks: DataFrame, k: int = END_K, n: int = END_N) -> DataFrame:
    """(side, kmer, exons, first_exon) of end k-mers held by more than one exon. Names are ranked, so that the smallest number is the smallest name."""
    ranked = materialize(global_rank(blocks.select("exon").distinct(), ["exon"], "number"))
    found = shared_numbers(end_bases(blocks.select("exon", "seq", "is_first", "is_last").join(ranked, "exon"), "number", k, n), k)
    return found.join(ranked.withColumnsRenamed({"number": "first", "exon": "first_exon"}), "first").select("side", "kmer", "exons", "first_exon")


def exon_numbers(blocks: DataFrame) -> DataFrame:
    """(exon, number, records): the smallest record number under each exon name, and how many there are."""
    return blocks.groupBy("exon").agg(F.min("rec_no").alias("number"), F.count(F.lit(1)).alias("records"))


def exon_components(blocks: DataFrame, k: int = END_K, n: int = END_N) -> DataFrame:
    """(exon, component): components of exons under shared end k-mers, named by their smallest exon. Names are looked up once, components are those of numbers."""
    numbers = exon_numbers(blocks)
    several = numbers.filter("records > 1").select("exon", "number")
    own = blocks.select("rec_no", "exon", "seq", "is_first", "is_last").join(several, "exon", "left").withColumn("number", F.coalesce("number", "rec_no"))
    roots = connected_components(exon_links(end_bases(own, "number", k, n), k))
    named = materialize(roots.join(numbers, F.col("node") == F.col("number")).select("exon", "root"))
    least = named.groupBy("root").agg(F.min("exon").alias("component"))
    return named.join(least, "root").select("exon", "component")


def merge_exons(blocks: DataFrame, components: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(exon, node) of merged exons; a node is named by its smallest exon.

    Exons of similar length all merge. Else the longest merges with all terminal ones,
    and is one of them; inner exons that are not longest stay alone. Ties in length go to the smallest name.
    """
    last = blocks.groupBy("exon").agg(F.max_by(F.char_length("seq"), "rec_no").alias("size"), F.max_by("terminal", "rec_no").alias("terminal"))
    members = components.join(last, "exon")
    stats = members.groupBy("component").agg(
        F.max("size").alias("most"), F.min("size").alias("least"),
        F.min(F.struct((-F.col("size")).alias("s"), "exon")).alias("big"),
    )
    judged = members.join(stats, "component").filter(
        (F.col("least") >= F.col("most") - similar) | F.col("terminal") | (F.col("exon") == F.col("big.exon"))
    )
    named = judged.groupBy("component").agg(F.min("exon").alias("node"))
    return judged.select("exon", "component").join(named, "component").select("exon", "node")


def node_labels(merged: DataFrame) -> DataFrame:
    """(node, label): the text of each merged node, its exons in ascending order. It is built once a node, where text is written."""
    return merged.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("exon")), "_OR_").alias("label"))


def merge_labels(merged: DataFrame) -> DataFrame:
    """(exon, label) of merged exons."""
    return merged.join(node_labels(merged), "node").select("exon", "label")


def relabel(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(line_no, src, dst) between nodes; edges may repeat or lead to themselves."""
    a = merged.select(F.col("exon").alias("src"), F.col("node").alias("_src"))
    b = merged.select(F.col("exon").alias("dst"), F.col("node").alias("_dst"))
    return edges.join(a, "src", "left").join(b, "dst", "left").select(
        "line_no", F.coalesce("_src", "src").alias("src"), F.coalesce("_dst", "dst").alias("dst")
    )


def with_labels(rows: DataFrame, merged: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with the labels of the nodes in ``columns`` in their place."""
    labels = node_labels(merged)
    for c in columns:
        own = labels.select(F.col("node").alias(c), F.col("label").alias("_label"))
        rows = rows.join(own, c, "left").withColumn(c, F.coalesce("_label", c)).drop("_label")
    return rows


def splice_graph(exons: DataFrame, k: int = END_K, n: int = END_N) -> tuple[DataFrame, DataFrame]:
    """Edges (line_no, src, dst) between the nodes of the merged graph of ``exons`` (rec_no, name, exon, seq), and its merged exons."""
    blocks = exon_blocks(exons)
    merged = merge_exons(blocks, exon_components(blocks, k, n))
    return relabel(chain_edges(blocks), merged), merged


def dot_line(src: Column, dst: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(";"))

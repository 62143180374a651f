"""Function-level chunks of Python source files, and stack frames looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.patterns import PY_DEF
from faultline.functions.text import let, trim_blank_left
from faultline.schema import SOURCE_CHUNK

BATCH_CHUNKS = 50
# Leading path parts that files numbered in one task share.
PREFIX_PARTS = 2
# Lines per bin of the frame lookup.
BIN_LINES = 64
# A place with this part of all frames is hot; there are never more hot places than this.
HOT_PARTS = 1024

# Fixed value: the first parameter that makes a function a method.
METHOD_PARAMETER = r"(?d)^[^(]*\((self|cls)([,) \t:]|\z)"


def chunk_hash(path: Column, content: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("\n"), content), 256)


def chunk_kind(def_line: Column) -> Column:
    return F.when(def_line.rlike(METHOD_PARAMETER), "method").otherwise("function")


def python_chunks(path: Column, source: Column) -> Column:
    """Array of chunks, one per ``def`` line at any depth.

    A function ends before the next live line (neither blank nor a comment) that is
    indented no deeper than its ``def``.  For one depth those lines are found once
    for the whole file, so the work is lines times distinct ``def`` depths.
    """

    def indent(line: Column) -> Column:
        return F.length(line) - F.length(trim_blank_left(line))

    def describe(line: Column, i: Column) -> Column:
        body = trim_blank_left(line)
        return F.struct(
            i.alias("at"),
            indent(line).alias("indent"),
            ((body != "") & ~body.startswith("#")).alias("live"),
            F.regexp_extract(line, PY_DEF, 2).alias("name"),
        )

    def from_lines(lines: Column) -> Column:
        def from_described(described: Column) -> Column:
            defs = F.filter(described, lambda d: d["name"] != "")
            depths = F.array_distinct(F.transform(defs, lambda d: d["indent"]))

            def at_depth(depth: Column) -> Column:
                borders = F.filter(described, lambda d: d["live"] & (d["indent"] <= depth))

                def pair(stops: Column) -> Column:
                    spans = F.transform(
                        stops,
                        lambda d, p: F.struct(
                            d["at"].alias("at"),
                            F.coalesce(F.get(stops, p + 1)["at"], F.size(lines)).alias("end"),
                            (d["indent"] == depth).alias("own"),
                            d["name"].alias("name"),
                        ),
                    )
                    return F.filter(spans, lambda s: s["own"] & (s["name"] != ""))

                return let(borders, pair)

            spans = F.array_sort(F.flatten(F.transform(depths, at_depth)))

            def chunk(span: Column) -> Column:
                start = span["at"] + 1
                content = F.array_join(
                    F.slice(lines, start, span["end"] - span["at"]), "\n"
                )
                return let(
                    content,
                    lambda text: F.struct(
                        path,
                        start,
                        span["end"],
                        chunk_kind(F.get(lines, span["at"])),
                        span["name"],
                        F.lit("python"),
                        text,
                        chunk_hash(path, text),
                    ).cast(SOURCE_CHUNK),
                )

            return F.transform(spans, chunk)

        return let(F.transform(lines, describe), from_described)

    return let(F.split(source, "\n", -1), from_lines)


def extract_chunks(files: DataFrame) -> DataFrame:
    """One row per chunk of files given as ``path, content``; other columns stay."""
    kept = [c for c in files.columns if c not in ("path", "content")]
    found = files.where(F.col("content") != "").select(
        *kept, python_chunks(F.col("path"), F.col("content")).alias("_chunks")
    )
    return found.select(*kept, F.posexplode("_chunks").alias("chunk_no", "_chunk")).select(
        *kept, "chunk_no", "_chunk.*"
    )


def walk_order(path: Column) -> Column:
    """Sort key of a directory walk: by name, one directory level at a time."""
    return F.split(path, "/")


def chunk_counts(files: DataFrame) -> DataFrame:
    """``repo, file_path, file_chunks`` of files given as ``repo, path, content``.

    A chunk begins at every ``def`` line, so these are counted and no chunk is cut out.
    """
    found = F.size(
        F.filter(F.split("content", "\n", -1), lambda line: F.regexp_extract(line, PY_DEF, 2) != "")
    )
    counted = files.select("repo", F.col("path").alias("file_path"), found.cast("bigint").alias("file_chunks"))
    return counted.where("file_chunks > 0")


def file_offsets(counts: DataFrame, parts: int = PREFIX_PARTS) -> DataFrame:
    """``counts`` with ``chunks_before``: the chunks in the earlier files of a repository, in walk order.

    ``counts`` has ``repo, file_path, file_chunks``.  Files that share their first ``parts`` path
    parts follow each other in the walk: they are numbered in one task, and of each such
    group one small row meets the others of its repository.  Nothing runs before the result does.
    """
    earlier = (Window.unboundedPreceding, -1)
    walked = counts.withColumn("_walk", walk_order(F.col("file_path"))).withColumn(
        "_prefix", F.slice("_walk", 1, parts)
    )
    inside = Window.partitionBy("repo", "_prefix").orderBy("_walk").rowsBetween(*earlier)
    across = Window.partitionBy("repo").orderBy("_prefix").rowsBetween(*earlier)
    carried = (
        walked.groupBy("repo", "_prefix")
        .agg(F.sum("file_chunks").alias("_total"))
        .select("repo", "_prefix", F.sum("_total").over(across).alias("_carried"))
    )
    before = F.coalesce("_local", F.lit(0)) + F.coalesce("_carried", F.lit(0))
    return (
        walked.withColumn("_local", F.sum("file_chunks").over(inside))
        .join(carried, ["repo", "_prefix"])
        .select("repo", "file_path", "file_chunks", before.alias("chunks_before"))
    )


def chunk_batches(
    files: DataFrame, repos: DataFrame, batch_chunks: int = BATCH_CHUNKS
) -> DataFrame:
    """Batches of chunks in walk order, then an empty ``done`` batch per repository.

    ``files`` has ``repo, path, content``; ``repos`` has ``repo, repo_url, branch,
    source_sha``, one row per repository.  A file is cut into chunks once, after its place is known.
    """

    def batch_of(rank: Column) -> Column:
        return F.call_function("div", rank, F.lit(batch_chunks).cast("bigint"))

    fields = [f.name for f in SOURCE_CHUNK.fields]
    offsets = file_offsets(chunk_counts(files))
    chunks = extract_chunks(files.select("repo", "path", "content"))
    rank = F.col("chunks_before") + F.col("chunk_no")
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.struct(*fields).alias("chunk"))))
    full = (
        chunks.join(offsets, ["repo", "file_path"])
        .withColumns({"rank": rank, "batch_no": batch_of(rank)})
        .groupBy("repo", "batch_no")
        .agg(F.transform(ordered, lambda s: s["chunk"]).alias("chunks"))
    )
    totals = offsets.groupBy("repo").agg(F.sum("file_chunks").alias("_total"))
    done = repos.join(totals, "repo", "left").select(
        "repo",
        batch_of(F.coalesce("_total", F.lit(0)) + batch_chunks - 1).alias("batch_no"),
        F.array().cast(full.schema["chunks"].dataType).alias("chunks"),
        F.lit(True).alias("done"),
    )
    batches = full.withColumn("done", F.lit(False)).unionByName(done)
    return batches.join(repos, "repo").select(
        F.col("repo").alias("repo_name"),
        "repo_url",
        "branch",
        "source_sha",
        "batch_no",
        "chunks",
        "done",
    )


def chunk_accounting(batches: DataFrame) -> DataFrame:
    """Chunks shipped and dropped per repository.

    ``batches`` has ``repo, batch_no, chunks, ok``.  A failed batch loses its own
    chunks and those of every later batch.
    """
    first = batches.where(~F.col("ok")).groupBy(F.col("repo").alias("_repo")).agg(F.min("batch_no").alias("_first"))
    met = batches.join(first, F.col("repo").eqNullSafe(F.col("_repo")), "left")
    lost = F.coalesce(F.col("batch_no") >= F.col("_first"), F.lit(False))
    return met.groupBy("repo").agg(
        F.coalesce(F.sum(F.when(~lost, F.col("chunks"))), F.lit(0)).alias("shipped"),
        F.coalesce(F.sum(F.when(lost, F.col("chunks"))), F.lit(0)).alias("dropped"),
    )


def frame_chunks(
    frames: DataFrame,
    chunks: DataFrame,
    chunk_columns: tuple[str, ...] = ("name", "kind", "start_line", "end_line"),
    bin_lines: int = BIN_LINES,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Frames with the innermost chunk that contains their line, if any.

    ``frames`` has ``filename, lineno``; ``chunks`` has ``file_path, start_line,
    end_line``.  Positions are made distinct first, so the range join runs once per
    place in the code, not once per event, and compares a position only with the
    chunks in its bin of lines.  Places are counted there: one with a ``hot_parts``-th of
    all frames or more gets as many salts as it has such parts, the others none.  There
    are ``hot_parts`` hot places at most, so they are broadcast to the frames.
    """

    def bin_of(line: Column) -> Column:
        return F.call_function("div", line.cast("bigint"), F.lit(bin_lines).cast("bigint"))

    counted = (
        frames.where(F.col("lineno").isNotNull())
        .groupBy("filename", "lineno")
        .agg(F.count("*").alias("_frames"))
    )
    total = counted.agg(F.sum("_frames")).scalar()
    share = F.col("_frames") * hot_parts
    salts = F.when(share >= total, F.ceil(share / total)).otherwise(1).cast("int")
    places = counted.select("filename", "lineno", bin_of(F.col("lineno")).alias("_bin"), salts.alias("_salts"))
    # A share of 1 / hot_parts makes one salt, which is none.
    hot = places.where("_salts > 1").select("filename", "lineno", "_salts")
    needed = dict.fromkeys(("start_line", "end_line", *chunk_columns))
    binned = chunks.select(
        F.col("file_path").alias("filename"),
        F.struct(*needed).alias("_chunk"),
        F.explode(F.sequence(bin_of(F.col("start_line")), bin_of(F.col("end_line")))).alias("_bin"),
    )
    line = F.col("lineno")
    inside = (F.col("_chunk.start_line") <= line) & (line <= F.col("_chunk.end_line"))
    innermost = (
        places.join(binned, ["filename", "_bin"])
        .where(inside)
        .groupBy("filename", "lineno", "_salts")
        .agg(F.max_by("_chunk", F.col("_chunk.start_line")).alias("_chunk"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        .drop("_salts")
    )
    # The salt is a function of the row and its task, so a repeated task salts alike.  Frames
    # without a line find nothing and go anywhere.
    plain = [f.name for f in frames.schema.fields if "map<" not in f.dataType.simpleString()]
    spot = F.xxhash64(*plain, F.spark_partition_id())
    ways = F.when(line.isNull(), hot_parts).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = (
        frames.join(F.broadcast(hot), ["filename", "lineno"], "left")
        .withColumn("_salt", F.pmod(spot, ways).cast("int"))
        .drop("_salts")
    )
    found = salted.join(innermost, ["filename", "lineno", "_salt"], "left")
    return found.select(
        *frames.columns,
        *(F.col(f"_chunk.{c}").alias(f"chunk_{c}") for c in chunk_columns),
    )

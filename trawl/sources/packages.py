"""Packages as tables: archives and folders found by path, and the files inside archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawl.functions.text import hit

# Where a listing does not look, how deep, and how much of an archive is read.
PRUNED = r"(^|/)(node_modules|\.git|\.vscode-test|out-test|__pycache__)/"
DEPTH, FOLDER_DEPTH = 8, 6
MAX_ENTRIES, MAX_BYTES = 20_000, 400 * 1024 * 1024
BATCH_ROWS, BATCH_BYTES = 1000, 16 * 1024 * 1024
ENTRIES = "target string, path string, size long, is_dir boolean, content binary, error string"


def below(path: Column, root: str) -> Column:
    """The part of a path under ``root``."""
    return F.regexp_replace(F.substring_index(path, root.rstrip("/"), -1), "^/+", "")


def list_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Paths and sizes only; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("size"))


def corpus_root(paths: Sequence[str], root: str, levels: int = 4) -> str:
    """The folder that holds a corpus: wrappers of one folder, named like the one above or as archives unpack, are entered.

    ``paths`` are the files below ``root`` (a listing; no contents are read).
    """
    held, at = {tuple(p.removeprefix(root.rstrip("/")).strip("/").split("/")) for p in paths if p.startswith(root)}, root.rstrip("/")
    for _ in range(levels):
        folders = {p[0] for p in held if len(p) > 1}
        shown = sorted(f for f in folders if not f.startswith("."))
        if {"extensions", "metadata"} <= folders or any(len(p) == 1 and p[0].lower().endswith(".vsix") for p in held):
            break
        if len(shown) != 1 or not (shown[0].lower() == at.rpartition("/")[2].lower() or shown[0] in ("vsmex-dataset", "vsmex-main", "extensions")):
            break
        held, at = {p[1:] for p in held if p[0] == shown[0] and len(p) > 1}, f"{at}/{shown[0]}"
    return at


def corpus_kind(paths: Sequence[str], root: str) -> str:
    """What a corpus is, by its folders or its name."""
    folders = {p.removeprefix(root.rstrip("/")).strip("/").split("/")[0] for p in paths if p.startswith(root) and "/" in p.removeprefix(root.rstrip("/")).strip("/")}
    name = root.rstrip("/").rpartition("/")[2].lower()
    if {"extensions", "metadata"} <= folders:
        return "vsmex"
    return next((f"datadog-{k}" for k in ("malicious", "benign") if k in name), "generic")


def chosen_corpora(corpora: Sequence[tuple[str, str]], wanted: str, present: Callable[[str], bool]) -> list[tuple[str, str]]:
    """Of ``(group, folder)`` those of the wanted group (``all``: every one) whose folder is there."""
    return [(g, d) for g, d in corpora if wanted.lower() in ("all", g.lower()) and present(d)]


def find_archives(spark: SparkSession, root: str) -> DataFrame:
    """``(target, is_dir, size)`` of all archives under ``root``."""
    inside = below(F.col("path"), root)
    found = list_files(spark, root, "*.[vV][sS][iI][xX]").where(~hit(inside, PRUNED) & (F.size(F.split(inside, "/")) <= DEPTH + 1))
    return found.select(F.col("path").alias("target"), F.lit(False).alias("is_dir"), "size")


def find_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders with a ``package.json`` and none above them."""
    inside = below(F.col("path"), root)
    found = list_files(spark, root, "package.json").where(~hit(inside, PRUNED) & (F.size(F.split(inside, "/")) <= FOLDER_DEPTH + 1))
    folders = found.select(F.regexp_replace("path", "/package.json$", "").alias("target")).distinct()
    parts = F.split("target", "/")
    above = folders.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("up"))
    nested = above.join(folders.select(F.col("target").alias("up")), "up", "left_semi").select("target").distinct()
    return folders.join(nested, "target", "left_anti").select("target", F.lit(True).alias("is_dir"))


def safe_path(path: Column) -> Column:
    """A path that stays inside its folder: no drive, no parent steps, no leading separators."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^[A-Za-z]:", ""), "/")
    return F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")


def archive_entries(spark: SparkSession, root: str, pattern: str = "*.[vV][sS][iI][xX]", contents: str = r".*") -> DataFrame:
    """``ENTRIES``: a row for each entry of each archive; contents only of names that match.

    Entries stored or deflated are read; others, and broken ones, carry an ``error``. Reading stops at the
    entry and byte limits of an archive. An archive that is none gives one error row.
    """
    import re

    wanted = re.compile(contents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary(), pa.string()]
        names = ["target", "path", "size", "is_dir", "content", "error"]
        rows, held = [], 0

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return made

        for batch in batches:
            for target, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spent = 0
                try:
                    archive = zipfile.ZipFile(io.BytesIO(raw.as_py()))
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    rows.append((target, "", 0, False, None, f"not an archive: {e}"))
                    continue
                for info in archive.infolist()[:MAX_ENTRIES]:
                    content = error = None
                    if not info.is_dir() and wanted.search(info.filename):
                        spent += info.file_size
                        if spent > MAX_BYTES:
                            error = "beyond the byte limit"
                        elif info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                            error = f"compression method {info.compress_type}"
                        else:
                            try:
                                content = archive.read(info)
                            except Exception as e:  # noqa: BLE001  a broken entry is a result
                                error = f"{type(e).__name__}: {e}"
                    rows.append((target, info.filename, info.file_size, info.is_dir(), content, error))
                    held += len(content or b"")
                    if len(rows) == BATCH_ROWS or held >= BATCH_BYTES:
                        yield flush()
                        held = 0
        if rows:
            yield flush()

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "content").mapInArrow(run, ENTRIES).withColumn("path", safe_path(F.col("path")))


def package_root(entries: DataFrame) -> DataFrame:
    """The folder of each archive's shallowest ``package.json``."""
    manifests = entries.where(F.col("path").rlike(r"(^|/)package\.json$") & ~F.col("path").rlike(r"(^|/)(node_modules|\.[^/]+)/"))
    depth = F.size(F.split("path", "/"))
    return manifests.groupBy("target").agg(F.min_by(F.regexp_replace("path", r"/?package\.json$", ""), F.struct(depth, F.col("path"))).alias("root"))


def entry_file(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """``(sample_key, path)`` of the file a package starts with: what its manifest names, a usual place, else its largest script."""
    usual = ["extension.js", "out/extension.js", "dist/extension.js", "out/src/extension.js", "lib/extension.js", "src/extension.js", "main.js", "index.js", "dist/index.js"]
    main = F.regexp_replace(F.coalesce("main", F.lit("")), r"^\./", "")
    browser = F.regexp_replace(F.coalesce("browser", F.lit("")), r"^\./", "")
    named = F.concat(F.array(main, F.concat(main, F.lit(".js")), F.concat(main, F.lit("/index.js"))), F.array(*map(F.lit, usual)), F.array(browser))
    ranked = files.join(manifests.select("sample_key", named.alias("named")), "sample_key").withColumn("place", F.array_position("named", F.col("path")))
    script = F.col("path").rlike(r"(?i)\.(js|cjs|mjs)$") & ~F.col("path").rlike(r"(?i)(^|/)(tests?|node_modules)/|\.test\.")
    order = F.when(F.col("place") > 0, F.struct(F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("path").alias("c"))).when(script, F.struct(F.lit(1000).cast("long").alias("a"), (-F.col("size")).cast("long").alias("b"), F.col("path").alias("c")))
    return ranked.withColumn("order", order).where("order IS NOT NULL").groupBy("sample_key").agg(F.min_by("path", "order").alias("path"))

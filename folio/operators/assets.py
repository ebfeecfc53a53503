"""Images and other attachments of notes: identity, kind and size, how to treat them, and where a reference leads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# First bytes of image formats, extensions' types, and bounds of what is worth a description.
MAGIC = (("image/png", "89504E470D0A1A0A"), ("image/gif", "47494638"), ("image/jpeg", "FFD8FF"), ("image/bmp", "424D"), ("image/webp", "52494646"))
LEAST_SIDE, MOST_RATIO, LEAST_BYTES = 100, 10, 5 * 1024
DECORATIVE = r"(?i)(logo|icon|badge|divider|avatar|banner)"


def asset_id(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(16))


def mime(content: Column) -> Column:
    """The type by the first bytes; SVG by its element; null for anything else."""
    head = F.hex(F.substring(content, 1, 12))
    out = None
    for kind, magic in MAGIC:
        out = F.when(head.startswith(magic), kind) if out is None else out.when(head.startswith(magic), kind)
    return out.when(F.try_validate_utf8(F.substring(content, 1, 512).cast("string")).rlike(r"(?is)^\s*(<\?xml[^>]*>\s*)?(<!--.*?-->\s*)*<svg[\s>]"), "image/svg+xml")


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    part = F.substring(content, at, size)
    digits = F.hex(F.reverse(part)) if little else F.hex(part)
    return F.conv(digits, 16, 10).cast("long")


@F.pandas_udf(StructType([StructField("width", LongType()), StructField("height", LongType())]))
def _jpeg(content: pd.Series) -> pd.DataFrame:
    """Sizes from the frame header of JPEG files, which follows other segments of stated lengths."""

    def one(data: bytes | None) -> tuple[int | None, int | None]:
        at = 2
        while data is not None and at + 9 <= len(data):
            if data[at] != 0xFF:
                at += 1
            elif 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            else:
                alone = data[at + 1] == 0xFF or 0xD0 <= data[at + 1] <= 0xD9
                at += (1 if data[at + 1] == 0xFF else 2) if alone else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    return pd.DataFrame([one(c) for c in content], columns=["width", "height"]).astype("Int64")


def dimensions(content: Column) -> Column:
    """struct<width, height> of PNG, GIF and JPEG headers and of SVG attributes; nulls where they can't be told."""
    text = F.try_validate_utf8(F.substring(content, 1, 2048).cast("string"))
    side = lambda name: F.regexp_extract(text, rf'(?is)<svg[^>]*\s{name}\s*=\s*["\'](\d+)', 1).try_cast("long")
    kind = mime(content)
    low = lambda at: F.conv(F.concat(F.hex(F.substring(content, at + 1, 1)), F.hex(F.substring(content, at, 1))), 16, 10).cast("long")
    width = F.when(kind == "image/png", _number(content, 17, 4)).when(kind == "image/gif", low(7)).when(kind == "image/svg+xml", side("width"))
    height = F.when(kind == "image/png", _number(content, 21, 4)).when(kind == "image/gif", low(9)).when(kind == "image/svg+xml", side("height"))
    jpeg = F.when(kind == "image/jpeg", _jpeg(content))
    return F.struct(F.coalesce(width, jpeg["width"]).alias("width"), F.coalesce(height, jpeg["height"]).alias("height"))


def treatment(name: Column, kind: Column, width: Column, height: Column, size: Column) -> Column:
    """use_svg: its text is in the file; decorative: too small, too narrow, too light or named so; need_vlm: everything else."""
    known = (width > 0) & (height > 0)
    narrow = F.greatest(width, height) > MOST_RATIO * F.least(width, height)
    slight = known & ((F.least(width, height) < LEAST_SIDE) | narrow) | ((size > 0) & (size < LEAST_BYTES)) | name.rlike(DECORATIVE)
    return F.when(kind == "image/svg+xml", "use_svg").when(F.coalesce(slight, F.lit(False)), "decorative").otherwise("need_vlm")


def attachment_index(files: DataFrame, path: str = "path") -> DataFrame:
    """(name, path): each file name's first path."""
    return files.groupBy(F.lower(F.element_at(F.split(path, "/"), -1)).alias("name")).agg(F.min(path).alias("path"))


def resolve(references: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``path`` to references (note_dir, src): the file beside the note, else below the root, else anywhere by its name; null for none and for remote ones."""
    rows = references.withColumn("__row", F.monotonically_increasing_id())
    clean = F.regexp_replace(F.url_decode(F.regexp_replace("src", r"\+", "%2B")), r"^\./", "")
    local = rows.where(~F.col("src").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")).select("__row", "note_dir", clean.alias("s"))
    beside = F.when(F.col("note_dir") == "", F.col("s")).otherwise(F.concat_ws("/", "note_dir", "s"))
    name = F.lower(F.element_at(F.split("s", "/"), -1))
    tries = local.select("__row", F.posexplode(F.array(F.struct(F.lit("p").alias("by"), beside.alias("key")), F.struct(F.lit("p").alias("by"), F.ltrim(F.col("s"), F.lit("/")).alias("key")), F.struct(F.lit("n").alias("by"), name.alias("key")))).alias("level", "t")).select("__row", "level", "t.*")
    known = files.select(F.lit("p").alias("by"), F.col("path").alias("key"), "path").unionByName(attachment_index(files).select(F.lit("n").alias("by"), F.col("name").alias("key"), "path"))
    best = tries.join(known, ["by", "key"]).groupBy("__row").agg(F.min_by("path", "level").alias("path"))
    return rows.join(best, "__row", "left").drop("__row")


def within_calls(images: DataFrame, most: int = 500) -> DataFrame:
    """The first ``most`` images that need a description, in the order of their ids: a run's allowance of model calls."""
    return images.where("treatment = 'need_vlm'").orderBy("asset_id").limit(most)

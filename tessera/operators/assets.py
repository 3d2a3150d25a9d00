"""Images of documents: names, sizes, content ids, caption blocks."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import structure as S

IMAGE_LINE = r"^!\[([^\]]*)\]\(([^)]+)\)(.*)$"


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def meaningful(width: Column, height: Column) -> Column:
    """Large enough and not a rule or a bar; unknown sizes aren't."""
    return F.coalesce((width >= 120) & (height >= 80) & F.try_divide(width, height).between(0.1, 10), F.lit(False))


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def dimensions(content: pd.Series) -> pd.DataFrame:
    """Width and height from the header of a PNG, JPEG, GIF, BMP or WebP image; null for anything else."""
    def one(b):
        if b is None:
            return None, None
        low = lambda at, n: int.from_bytes(b[at:at + n], "little")
        if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
            return low(6, 2), low(8, 2)
        if b[:2] == b"BM" and len(b) >= 26:
            return low(18, 4), abs(int.from_bytes(b[22:26], "little", signed=True))
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
            if b[12:16] == b"VP8X":
                return low(24, 3) + 1, low(27, 3) + 1
            if b[12:16] == b"VP8L":
                return (low(21, 4) & 0x3FFF) + 1, (low(21, 4) >> 14 & 0x3FFF) + 1
            return low(26, 2) & 0x3FFF, low(28, 2) & 0x3FFF
        if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
            return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
        i = 2
        while b[:2] == b"\xff\xd8" and i + 9 <= len(b) and b[i] == 0xFF:
            if 0xC0 <= b[i + 1] <= 0xCF and b[i + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[i + 7:i + 9], "big"), int.from_bytes(b[i + 5:i + 7], "big")
            i += 2 + int.from_bytes(b[i + 2:i + 4], "big")
        return None, None

    return pd.DataFrame([one(b) for b in content], columns=["width", "height"]).astype("Int32")


def new_names(images: DataFrame) -> DataFrame:
    """images(file_path, seq, path) with new_path: good names stay, others become img_000001 and so on by document."""
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    bad = ~stem.rlike(r"^[A-Za-z0-9_-]{1,20}$")
    first = images.withColumn("_bad", bad).groupBy("file_path", "path", "_bad").agg(F.min("seq").alias("_at"))
    n = F.sum(F.col("_bad").cast("int")).over(Window.partitionBy("file_path").orderBy("_at", "path"))
    new = F.when(F.col("_bad"), F.concat(F.regexp_extract("path", r"^(.*/)?", 0), F.lit("img_"), F.lpad(n.cast("string"), 6, "0"), F.regexp_extract("path", r"(\.[^./]*)?$", 0))).otherwise(F.col("path"))
    return images.join(first.select("file_path", "path", new.alias("new_path")), ["file_path", "path"])


def captions(images: DataFrame, caption) -> DataFrame:
    """image_id, caption: each content once, whatever the number of links to it. caption: column of a scorer."""
    return images.dropDuplicates(["image_id"]).withColumn("caption", caption).select("image_id", "caption")


def apply_captions(docs: DataFrame, images: DataFrame, model: str = "offline") -> DataFrame:
    """docs(file_path, text) with caption blocks after image links: file_path, text, and counts new, kept, replaced, missing.

    images(file_path, path, new_path, image_id, width, height, caption): known files; links to others are kept and counted as missing.
    A block with the image's id stays, without an id it gets one, with another id it is replaced. Text after a link stays.
    An error in one document is its row's error; other rows go on.
    """
    known = images.groupBy("file_path").agg(F.collect_list(F.struct("path", "new_path", "image_id", "width", "height", "caption")).alias("images"))
    schema = "file_path string, text string, new int, kept int, replaced int, missing int, error string"

    def one(text, known):
        lines, out, i, count = text.split("\n"), [], 0, {"new": 0, "kept": 0, "replaced": 0, "missing": 0}
        while i < len(lines):
            m = re.match(IMAGE_LINE, lines[i])
            i += 1
            if not m:
                out.append(lines[i - 1])
                continue
            image = known.get(m[2])
            if image is None:
                count["missing"] += 1
                out.append(lines[i - 1])
                continue
            out.append(f"![{m[1]}]({image['new_path'] or m[2]}){m[3]}")
            w, h = image["width"], image["height"]
            if not (w and h and w >= 120 and h >= 80 and 0.1 <= w / h <= 10):
                continue
            block = S.read_caption_block(lines, i)
            caption = image["caption"] or ""
            if block:
                same = block[2].get("id") in (None, image["image_id"])
                count["kept" if same else "replaced"] += 1
                caption = "\n".join(block[3]).strip() if same else caption
                i = block[1] + 1
            else:
                count["new"] += 1
            out += S.caption_block(image["image_id"], model, caption)[:-1]
        return "\n".join(out), count

    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):  # Python holds the objects of few documents
                rows = []
                for r in b.slice(i, 256).to_pylist():
                    path, text = r["file_path"], r["text"]
                    try:
                        new, count = one(text or "", {x["path"]: x for x in r["images"] or []})
                        rows.append({"file_path": path, "text": new, **count, "error": None})
                    except Exception as e:  # isolated to the document, and reported
                        rows.append({"file_path": path, "text": text, "new": 0, "kept": 0, "replaced": 0, "missing": 0, "error": str(e)})
                yield pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)

    return docs.select("file_path", "text").join(known, "file_path", "left").mapInArrow(run, schema)


def caption_fields(text: Column) -> Column:
    """image_id, model, status and caption of the first caption block of a text; null without one."""
    block = F.regexp_extract(text, r"(?sm)^\*\[Image OCR\]\*[ \t]*\n(.*?)^\*\[End OCR\]\*[ \t]*$", 1)
    field = lambda name: F.nullif(F.regexp_extract(block, rf"(?m)^{name}: *(.*)$", 1), F.lit(""))
    body = F.regexp_replace(F.regexp_replace(block, r"(?s)^.*?\n\*\n", ""), r"^\s+|\s+$", "")
    return F.when(block != "", F.struct(field("id").alias("image_id"), field("model").alias("model"), field("status").alias("status"), body.alias("caption")))


def run_counters(done: DataFrame) -> DataFrame:
    return done.agg(F.count("*").alias("files"), F.count_if(F.col("error").isNotNull()).alias("failed"), *[F.sum(c).alias(c) for c in ("new", "kept", "replaced", "missing")])


@F.pandas_udf(T.BooleanType())
def valid_office(content: pd.Series) -> pd.Series:
    """Is the content a readable zip, as office files are?"""
    def ok(b):
        try:
            with zipfile.ZipFile(io.BytesIO(b)) as z:
                return z.testzip() is None
        except (zipfile.BadZipFile, TypeError, EOFError):
            return False

    return content.map(ok)



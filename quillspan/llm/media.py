"""Media columns: texts stored as lossless WebP images, and WebP columns read into pixel arrays.

Definitions that hold for every row: a null text or file is an empty one; a text is stored as its UTF-8 bytes and zeros
up to a positive multiple of 64; texts over 1 MiB become several images that follow each other in one value, so that
an image never needs more than a few MB; equal texts give equal values; repeated rows, null ids and extra columns do no
harm; a broken file gives one row with ``error`` set and no pixels; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm import webp

UNIT = 64
WIDTH = 16  # pixels: 64 bytes a row
IMAGE_BYTES = 1 << 20
SLICE = 512  # rows in work at once
MOST_PIXELS = 1 << 24  # 64 MB of samples
#: transforms by the checksum of an image's bytes
DEALT = ((), (), (), (), (), (webp.SUBTRACT_GREEN,), (webp.PREDICTOR,), (webp.CROSS_COLOUR,))


def store(text: bytes | None) -> bytes:
    data = text or b""
    data += b"\0" * (-len(data) % UNIT or (0 if data else UNIT))
    samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 4)
    rows = IMAGE_BYTES // UNIT
    images = (samples[at : at + rows] for at in range(0, len(samples), rows))
    return b"".join(webp.encode(x, DEALT[zlib.crc32(x) % len(DEALT)]) for x in images)


def read(media: bytes) -> bytes:
    """The payload of a stored text."""
    return b"".join(webp.decode(f)[2].tobytes() for f in webp.files(media))


def feature(payload: bytes) -> str:
    """A 64-bit average hash over 64 equal stretches, and the mean of each channel, of the pixels read back."""
    x = np.frombuffer(payload, np.uint8)
    means = x.reshape(64, -1).mean(axis=1)
    bits = np.packbits(means > means.mean()).tobytes().hex()
    return bits + "-" + "-".join(f"{m:.3f}" for m in x.reshape(-1, 4).mean(axis=0))


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as WebP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(map(store, texts), pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def describe(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored texts,
    all but the media's own taken from the pixels read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = []
                for media in batch.column("media").to_pylist():
                    p = read(media)
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def pixels(files: DataFrame, key: str, media: str, most_pixels: int = MOST_PIXELS) -> DataFrame:
    """key, image, width, height, pixels (RGBA bytes, row by row), error: one row an image of a column of WebP files, each
    passed on before the next is read. An image of more than ``most_pixels`` is an error row, refused by its declared size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())

        def row(key, *values):
            return pa.RecordBatch.from_arrays([pa.array([key.as_py()], key.type), *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]], ["key", "image", "width", "height", "pixels", "error"])

        for batch in batches:
            for key, data in zip(batch.column("key"), batch.column("media"), strict=True):
                n = 0
                try:
                    for n, file in enumerate(webp.files(data.as_py() or b"")):
                        w, h, px = webp.decode(file, most_pixels)
                        yield row(key, n, w, h, px[..., [2, 1, 0, 3]].tobytes(), None)
                except (ValueError, IndexError, struct.error) as e:
                    yield row(key, n, None, None, None, str(e))

    rows = files.select(F.col(key).alias("key"), F.col(media).alias("media"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, image long, width long, height long, pixels binary, error string").withColumnRenamed("key", key)

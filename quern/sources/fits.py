"""FITS files: header cards, image and table extensions, read with numpy in the executors."""

from __future__ import annotations

import io
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: bytes of a block and of a card, and element types.
BLOCK, CARD = 2880, 80
IMAGE_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
COLUMN_TYPES = {"L": "u1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8", "A": "S"}


def _cards(stream: io.BytesIO) -> dict | None:
    out: dict = {}
    while True:
        block = stream.read(BLOCK)
        if len(block) < BLOCK:
            return None
        for at in range(0, BLOCK, CARD):
            card = block[at : at + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return out
            if card[8:10] == "= ":
                text = card[10:].strip()
                if text.startswith("'"):
                    out[key] = text[1:].split("'")[0].rstrip()
                else:
                    text = text.split("/")[0].strip()
                    out[key] = text == "T" if text in ("T", "F") else float(text) if any(c in text for c in ".E") else int(text or 0)


def read_extensions(data: bytes) -> list[tuple[dict, np.ndarray | dict[str, np.ndarray] | None]]:
    """(cards, data) of each extension: an image array, a dict of table columns, or nothing. Native byte order."""
    stream, out = io.BytesIO(data), []
    while (cards := _cards(stream)) is not None:
        shape = [int(cards[f"NAXIS{i}"]) for i in range(int(cards.get("NAXIS", 0)), 0, -1)]
        width = abs(int(cards.get("BITPIX", 8))) // 8
        size = (math.prod(shape) if shape else 0) * width + int(cards.get("PCOUNT", 0) or 0)
        raw = stream.read(size)
        stream.seek(-stream.tell() % BLOCK, 1)
        if not shape:
            out.append((cards, None))
        elif cards.get("XTENSION") == "BINTABLE":
            fields = []
            for i in range(1, int(cards["TFIELDS"]) + 1):
                form = str(cards[f"TFORM{i}"])
                count, kind = int(form[:-1] or 1), form[-1]
                name = str(cards.get(f"TTYPE{i}", f"col{i}"))
                fields.append((name, f"S{count}") if kind == "A" else (name, COLUMN_TYPES[kind], (count,)) if count > 1 else (name, COLUMN_TYPES[kind]))
            table = np.frombuffer(raw, np.dtype(fields), count=shape[0])
            out.append((cards, {n: table[n].astype(table[n].dtype.newbyteorder("=")) for n in table.dtype.names}))
        else:
            kind = np.dtype(IMAGE_TYPES[int(cards["BITPIX"])])
            out.append((cards, np.frombuffer(raw, kind, count=math.prod(shape)).reshape(shape).astype(kind.newbyteorder("="))))
    return out


def write_image(array: np.ndarray, cards: dict | None = None) -> bytes:
    """A file with one image."""
    code = {np.dtype(v).newbyteorder("="): k for k, v in IMAGE_TYPES.items()}[array.dtype]
    head = {"SIMPLE": True, "BITPIX": code, "NAXIS": array.ndim} | {f"NAXIS{i + 1}": n for i, n in enumerate(reversed(array.shape))} | (cards or {})
    show = lambda v: "T" if v is True else "F" if v is False else f"'{v}'" if isinstance(v, str) else repr(v)
    text = "".join(f"{k:<8}= {show(v):>20}".ljust(CARD) for k, v in head.items()) + "END".ljust(CARD)
    text = text.ljust(-(-len(text) // BLOCK) * BLOCK)
    body = array.astype(IMAGE_TYPES[code]).tobytes()
    return text.encode() + body + bytes(-len(body) % BLOCK)


def read_images(spark: SparkSession, path: str, extension: int = 0) -> DataFrame:
    """path, row, values of the rows of an image extension of each file; a file is read by one task."""
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                _, image = read_extensions(bytes(content))[extension]
                for i, row in enumerate(np.atleast_2d(image)):
                    rows.append((name, i, [float(v) for v in row]))
            yield pd.DataFrame(rows, columns=["path", "row", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, row long, values array<double>")

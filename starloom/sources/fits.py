"""FITS files: primary, image and binary-table units, read from any store that Spark reads and written to bytes.

The reader decodes the binaryFile source's content on executors, a row for each unit; structure: blocks of 2880 bytes, cards of
80 characters, big-endian data.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.operators import selection

BLOCK, CARD = 2880, 80
DTYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
TABLE = {"L": ("?", 1), "B": (">u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8), "E": (">f4", 4), "D": (">f8", 8), "A": ("S", 1)}
SCHEMA = "path string, ext_idx int, extname string, kind string, header map<string,string>, shape array<int>, pix array<double>, table_json string"


def value_of(card: str):
    """The value of a card and its comment."""
    raw = card[10:]
    if raw.lstrip().startswith("'"):
        m = re.match(r"\s*'((?:[^']|'')*)'", raw)
        return m[1].replace("''", "'").rstrip() if m else raw.strip()
    raw = raw.split("/", 1)[0].strip()
    if raw in ("T", "F"):
        return raw == "T"
    try:
        return int(raw)
    except ValueError:
        try:
            return float(raw.replace("D", "E"))
        except ValueError:
            return raw


def header_at(data: bytes, at: int) -> tuple[dict, int]:
    """The header that begins at a place, and where its data begin."""
    out: dict = {}
    while at < len(data):
        block = data[at : at + BLOCK].decode("ascii", "replace")
        at += BLOCK
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD]
            name = card[:8].strip()
            if name == "END":
                return out, at
            if card[8:10] == "= ":
                out[name] = value_of(card)
            elif name in ("HISTORY", "COMMENT") and card[8:].strip():
                out[name] = (out[name] + "\n" if name in out else "") + card[8:].strip()
    raise ValueError("a header has no END")


def units(data: bytes) -> Iterator[tuple[dict, str, list[int], np.ndarray | None]]:
    """(header, kind, shape, array) of each unit, in native byte order."""
    at = 0
    while at + BLOCK <= len(data):
        head, start = header_at(data, at)
        axes = [int(head[f"NAXIS{k}"]) for k in range(1, int(head.get("NAXIS", 0)) + 1)]
        bits, n = int(head.get("BITPIX", 8)), math.prod(axes) if axes else 0
        size = abs(bits) // 8 * int(head.get("GCOUNT", 1)) * (int(head.get("PCOUNT", 0)) + n)
        raw, kind, arr = data[start : start + size], "primary" if at == 0 else "image", None
        if head.get("XTENSION") == "BINTABLE":
            kind, fields = "bintable", []
            for k in range(1, int(head["TFIELDS"]) + 1):
                count, code = re.match(r"(\d*)([A-Z])", head[f"TFORM{k}"]).groups()
                count, (dt, _) = int(count or 1), TABLE[code]
                fields.append((head.get(f"TTYPE{k}", f"col{k}"), f"S{count}" if code == "A" else dt, *(() if code == "A" or count == 1 else ((count,),))))
            arr = np.frombuffer(raw[: axes[0] * axes[1]], np.dtype(fields))
        elif n:
            arr = np.frombuffer(raw[: n * abs(bits) // 8], DTYPES[bits]).reshape(axes[::-1])
            scale, zero = head.get("BSCALE", 1), head.get("BZERO", 0)
            arr = arr.astype(float) * scale + zero if (scale, zero) != (1, 0) else arr.astype(arr.dtype.newbyteorder("="))
        yield head, kind, axes[::-1], arr
        at = start + -(-size // BLOCK) * BLOCK


def exists(spark: SparkSession, *paths: str) -> bool:
    """Whether any of the paths is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return any((p := hadoop(path)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for path in paths)


def inputs(spark: SparkSession, path: str, every: int = 1, extensions: tuple[str, ...] = ("fit", "fits")) -> DataFrame:
    """(path, content) of the files of a glob, of a directory those with the extensions, or of one file; each so-manieth in order of
    the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.read.format("binaryFile")
    if "*" not in path and at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    files = reader.load(path).select("path", "content")
    if every > 1:
        names = selection.numbered(files.select("path"), "path").where(F.col("frame_idx") % every == 0).select("path")
        files = files.join(F.broadcast(names), "path", "left_semi")  # paths: the driver's listing holds them all as it is
    return files


def joined(folder: Column, name: Column) -> Column:
    """A path or URL and a name below it."""
    return F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), name)


def basename(path: Column) -> Column:
    """The last part of a path or URL."""
    return F.element_at(F.split(path, "/"), -1)


def read(spark: SparkSession, path: str, every: int = 1) -> DataFrame:
    """A row for each unit of the files of inputs(). A file that can't be read is named in the error."""
    files = inputs(spark, path, every)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, content in zip(df["path"], df["content"], strict=True):
                rows = []
                try:
                    parts = list(units(bytes(content)))
                    if not parts:
                        raise ValueError("no units")
                except Exception as e:
                    raise ValueError(f"{name} is no readable FITS file") from e
                for k, (head, kind, shape, arr) in enumerate(parts):
                    table = None
                    if kind == "bintable":
                        table = pd.DataFrame({c: [x.decode().rstrip("\0 ") if isinstance(x, bytes) else x for x in arr[c].tolist()] for c in arr.dtype.names}).to_json(orient="records")
                    pix = arr.astype(float).ravel().tolist() if arr is not None and kind != "bintable" else None
                    rows.append((name, k, head.get("EXTNAME") or ("PRIMARY" if k == 0 else None), kind, {a: str(b) for a, b in head.items()}, shape, pix, table))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(run, SCHEMA)


def card(name: str, value, comment: str = "") -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{value:>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value)!r:>20}".upper()
    else:
        text = "'" + str(value).replace("'", "''").ljust(8) + "'"
    return f"{name:<8}= {text}{' / ' + comment if comment else ''}"[:CARD].ljust(CARD).encode("ascii", "replace")


def padded(raw: bytes, with_: bytes) -> bytes:
    return raw + with_ * (-len(raw) % BLOCK)


def unit(arr: np.ndarray | None, header: dict | None = None, first: bool = True, name: str | None = None) -> bytes:
    """An image unit of an array, as bytes."""
    kinds = {np.dtype(v).newbyteorder("=").str[1:]: k for k, v in DTYPES.items()}
    bits = 8 if arr is None else kinds[arr.dtype.newbyteorder("=").str[1:]]
    axes = [] if arr is None else list(arr.shape[::-1])
    cards = [card("SIMPLE", True) if first else card("XTENSION", "IMAGE"), card("BITPIX", bits), card("NAXIS", len(axes)), *(card(f"NAXIS{k + 1}", n) for k, n in enumerate(axes))]
    cards += [] if first else [card("PCOUNT", 0), card("GCOUNT", 1)]
    cards += [card("EXTNAME", name)] if name else []
    skip = {"SIMPLE", "XTENSION", "BITPIX", "NAXIS", "PCOUNT", "GCOUNT", "EXTNAME", "END"}
    cards += [card(k, v) for k, v in (header or {}).items() if k not in skip and not k.startswith("NAXIS")]
    data = b"" if arr is None else np.ascontiguousarray(arr).astype(DTYPES[bits]).tobytes()
    return padded(b"".join(cards) + b"END".ljust(CARD), b" ") + padded(data, b"\0")


def table_unit(table: np.ndarray, name: str | None = None) -> bytes:
    """A binary-table unit of a structured array."""
    code = {"i2": "I", "i4": "J", "i8": "K", "f4": "E", "f8": "D", "u1": "B"}
    forms = [f"{dt.itemsize}A" if dt.kind == "S" else code[dt.str[1:]] for dt in (table.dtype[k] for k in range(len(table.dtype)))]
    big = table.astype([(n, table.dtype[n].newbyteorder(">")) for n in table.dtype.names])
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", big.dtype.itemsize), card("NAXIS2", len(big)), card("PCOUNT", 0), card("GCOUNT", 1), card("TFIELDS", len(forms))]
    for k, (n, f) in enumerate(zip(table.dtype.names, forms, strict=True), 1):
        cards += [card(f"TTYPE{k}", n), card(f"TFORM{k}", f)]
    cards += [card("EXTNAME", name)] if name else []
    return padded(b"".join(cards) + b"END".ljust(CARD), b" ") + padded(big.tobytes(), b"\0")


def write(path: str, parts: list[bytes], overwrite: bool = False) -> None:
    """Units as one file; an existing file is refused unless overwrite is set."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    with store.open_output_stream(at) as out:
        out.write(b"".join(parts))

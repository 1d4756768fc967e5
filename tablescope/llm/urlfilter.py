"""URL filters over a sorted digest array.

Rules are (host, path prefix, verdict).  Their strings ``host + path`` are hashed with
64-bit xxhash; the keys are sorted into one file, the strings lie in a second one in
the same order.  Both files go to every executor once and are memory-mapped by its
workers.  A task derives for all its urls the strings a rule could have (every host
suffix with every prefix of the path that is as long as some rule's path), hashes
them, finds them with a vectorised binary search, and confirms each hit against the
stored string, so equal keys of different strings cannot mislead.

The files hold at most ``MAX_ARRAY_BYTES``.  A larger rule table is cut by key into digest
arrays of about ``SEGMENT_BYTES``, one to a task.  A block of urls sends each of its distinct
candidate strings once to the segment of its key and gets back the rules found, so a rule that fits
nearly every url is asked for once a block.  Both ways give the same verdicts.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
then up to ``?``, ``#`` or the end.  A rule fits its host and all subdomains if the path
starts with the rule's; the longest rule string wins, of equally long ones the longer host.

Defined results: a null url, or one without ``://``, has an empty host and path and
fits no rule; an empty path starts only with an empty one; without a fitting rule the
verdict is ``DEFAULT_VERDICT``; of equal rules the verdict ``block`` wins; rules with a
null host are ignored, a null path is empty; equal rows are judged alike.
"""
from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tablescope.llm import skew
from tablescope.llm.blockcount import new_block
from tablescope.session import ship_package

DEFAULT_VERDICT = "allow"
MAX_ARRAY_BYTES = 512 << 20
SEGMENT_BYTES = 32 << 20
URL = r"^[\s\S]*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def candidates(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """(host suffix, path prefix) pairs a rule could have."""
    if not host:
        return []
    suffixes = [host]
    at = host.find(".")
    while at >= 0:
        if at + 1 < len(host):
            suffixes.append(host[at + 1:])
        at = host.find(".", at + 1)
    return [(s, path[:n]) for s in suffixes for n in lengths if n <= len(path)]


def rule_text(host: str, path: str) -> bytes:
    return f"{host}\0{path}".encode()


class DigestArray:
    """Rules as sorted keys, offsets, and records of verdict and string; memory-mapped where they come from files."""

    NAMES = "keys", "offsets", "records"

    def __init__(self, folder: str, stem: str):
        self.keys, self.offsets, self.records = (np.load(os.path.join(folder, f"{stem}-{name}.npy"), mmap_mode="r") for name in self.NAMES)

    @classmethod
    def of(cls, rules: list[tuple[str, str, str]]) -> "DigestArray":
        """In memory, without files."""
        array = cls.__new__(cls)
        arrays = cls.make(rules)
        array.keys, array.offsets, array.records = (arrays[name] for name in cls.NAMES)
        return array

    @staticmethod
    def make(rules: list[tuple[str, str, str]]) -> dict[str, np.ndarray]:
        found: dict[tuple[str, str], str] = {}
        for host, path, verdict in rules:
            if found.get((host, path)) != "block":
                found[host, path] = verdict
        rows = sorted((xxhash.xxh64_intdigest(rule_text(h, p)), v[:1].encode() + rule_text(h, p)) for (h, p), v in found.items())
        return {"keys": np.array([k for k, _ in rows], np.uint64),
                "offsets": np.r_[0, np.cumsum([len(r) for _, r in rows])].astype(np.int64),
                "records": np.frombuffer(b"".join(r for _, r in rows) or b"\0", np.uint8)}

    @staticmethod
    def build(rules: list[tuple[str, str, str]], folder: str, stem: str) -> list[str]:
        paths = []
        for name, array in DigestArray.make(rules).items():
            paths.append(os.path.join(folder, f"{stem}-{name}.npy"))
            np.save(paths[-1], array)
        return paths

    def probe(self, strings: list[bytes]) -> list[str | None]:
        """The verdict letter of each candidate, or None."""
        if not len(self.keys) or not strings:
            return [None] * len(strings)
        digests = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, digests)
        out: list[str | None] = [None] * len(strings)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # confirm the full string
                record = self.records[self.offsets[k]:self.offsets[k + 1]].tobytes()
                if record[1:] == strings[i]:
                    out[i] = chr(record[0])
                    break
                k += 1
        return out


_open: dict[str, DigestArray] = {}


def _judge(hosts: pd.Series, paths: pd.Series, array: DigestArray, lengths: list[int], default: str) -> pd.DataFrame:
    owner, pairs = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        some = candidates(host, path, lengths)
        owner.extend([i] * len(some))
        pairs.extend(some)
    letters = array.probe([rule_text(h, p) for h, p in pairs])
    best: list[tuple | None] = [None] * len(hosts)
    for i, (host, path), letter in zip(owner, pairs, letters):
        if letter is not None:
            rank = (len(host) + len(path), len(host), host + path, letter)
            if best[i] is None or rank > best[i]:
                best[i] = rank
    names = {"a": "allow", "b": "block"}
    return pd.DataFrame({"rule": [b and b[2] for b in best], "verdict": [names[b[3]] if b else default for b in best]})


VERDICT = StructType([StructField("rule", StringType()), StructField("verdict", StringType())])


def filter_urls(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], url: str = "url",
                default: str = DEFAULT_VERDICT, max_array_bytes: int = MAX_ARRAY_BYTES,
                segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``pages`` as the struct column ``row`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules``: (host, path, verdict) rows, verdict ``allow`` or ``block``.
    """
    spark = pages.sparkSession
    ship_package(spark)
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = (rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
             .select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict"))
    size, lengths = rules.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 24), F.lit(0)),
                              F.sort_array(F.collect_set(F.length("path")))).first()
    base = pages.select(F.struct(*[pages[c].alias(c) for c in pages.columns]).alias("row"),
                        url_host(pages[url]).alias("host"), url_path(pages[url]).alias("path"))
    if size > max_array_bytes:
        return _dealt(base, rules, list(lengths), default, -(-size // segment_bytes))
    stem = f"urlrules-{uuid.uuid4().hex[:12]}"
    folder = tempfile.mkdtemp(prefix="tablescope-rules-")
    for path in DigestArray.build([tuple(r) for r in rules.collect()], folder, stem):
        spark.sparkContext.addFile(path)  # the driver's file server gives every executor its copy
    lengths = list(lengths)

    @F.pandas_udf(VERDICT)
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        if stem not in _open:
            _open[stem] = DigestArray(SparkFiles.getRootDirectory(), stem)
        return _judge(host, path, _open[stem], lengths, default)

    return base.withColumn("judged", judge("host", "path")).select("row", "host", "path", "judged.rule", "judged.verdict")


class FoundRules:
    """The rules that a block's candidates have met, to be asked like a ``DigestArray``."""

    def __init__(self, texts: list[bytes], letters: list[str]):
        self.found = dict(zip(texts, letters))

    def probe(self, strings: list[bytes]) -> list[str | None]:
        return [self.found.get(s) for s in strings]


def segment_of(text: bytes, segments: int) -> int:
    """The segment of a rule string: its key's place in the range of keys."""
    return xxhash.xxh64_intdigest(text) * segments >> 64


def _dealt(base: DataFrame, rules: DataFrame, lengths: list[int], default: str, segments: int) -> DataFrame:
    """The same verdicts from digest arrays by segment: blocks ask the segments and get the rules found back."""
    from pyspark.sql.pandas.types import to_arrow_schema
    row = StructField("row", base.schema["row"].dataType)   # null beside a block's questions
    urls = [row, StructField("host", StringType()), StructField("path", StringType())]
    asked = StructType([StructField("block", LongType()), *urls, StructField("part", IntegerType()), StructField("texts", ArrayType(BinaryType()))])
    asked_schema = to_arrow_schema(asked)
    none = pa.nulls

    def ask(batches):
        for batch in batches:
            name, many = new_block(), batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([name] * many, pa.int64()), *batch.columns, none(many, pa.int32()), none(many, asked_schema.field("texts").type)],
                                             schema=asked_schema)
            parts: dict[int, set[bytes]] = {}
            for host, path in set(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                for pair in candidates(host, path, lengths):
                    text = rule_text(*pair)
                    parts.setdefault(segment_of(text, segments), set()).add(text)
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.int64()), none(k, asked_schema.field("row").type), none(k, pa.string()), none(k, pa.string()),
                                              pa.array(list(parts), pa.int32()), pa.array([list(p) for p in parts.values()], asked_schema.field("texts").type)],
                                             schema=asked_schema)

    def place(batches):
        for batch in batches:
            parts = [segment_of(rule_text(h, p), segments) for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], names=["part", "host", "path", "verdict"])

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        array = DigestArray.of(list(zip(*(right.column(c).to_pylist() for c in ("host", "path", "verdict")))))
        blocks, texts, letters = [], [], []
        for block, strings in zip(left.column("block").to_pylist(), left.column("texts").to_pylist()):
            met = [(s, letter) for s, letter in zip(strings, array.probe(strings)) if letter is not None]
            blocks.append(block)
            texts.append([s for s, _ in met])
            letters.append([letter for _, letter in met])
        return pa.table({"block": pa.array(blocks, pa.int64()), "texts": pa.array(texts, pa.list_(pa.binary())), "letters": pa.array(letters, pa.list_(pa.string()))})

    out = StructType([*urls, *VERDICT.fields])
    out_schema = to_arrow_schema(out)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rules = FoundRules(*([x for cell in right.column(c).to_pylist() for x in cell] for c in ("texts", "letters")))
        judged = _judge(left.column("host").to_pandas(), left.column("path").to_pandas(), rules, lengths, default)
        return pa.table([*(left.column(f.name) for f in urls), pa.array(judged["rule"], pa.string(), from_pandas=True), pa.array(judged["verdict"], pa.string())],
                        schema=out_schema)

    staged = skew.written(base.mapInArrow(ask, asked), "url-blocks")
    placed = rules.mapInArrow(place, "part int, host string, path string, verdict string")
    answers = (staged.where("part is not null").select("block", "part", "texts").groupBy("part").cogroup(placed.groupBy("part"))
               .applyInArrow(probe, "block long, texts array<binary>, letters array<string>"))
    return (staged.where("part is null").select("block", *[f.name for f in urls]).groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(finish, out))

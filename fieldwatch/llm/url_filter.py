"""URL filter: a sorted array of 64-bit digests, memory-mapped on every executor.

Rules are kept as three files: their sorted XXH64 digests, the places of their strings in the same
order, and the strings. Spark ships the files once to every executor, whose workers map them, so a
list of hundreds of megabytes is held once per machine. A URL's candidates (each parent of its host
with each rule path length) are hashed, found by one vectorised binary search per batch, and
confirmed against the stored string, as two strings may share a digest.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT = "allow"          # the verdict where no rule fits: the list names exceptions
MAX_RULES = 100_000_000    # digests and places take 24 bytes a rule; longer lists belong in a join


def digest(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


class DigestArray:
    """Rules ``(verdict, host, path)`` as mapped arrays; ``hosts`` answers first, ``rules`` then."""

    def __init__(self, find: Callable[[str], str], hashed: Callable[[bytes], int] = digest):
        """``find`` gives the place of each file that :meth:`write` made."""
        self.hashed = hashed
        self.parts = {name: (np.load(find(f"{name}.digests.npy"), mmap_mode="r"),
                             np.load(find(f"{name}.places.npy"), mmap_mode="r"),
                             np.memmap(find(f"{name}.strings"), np.uint8, "r"))
                      for name in ("hosts", "rules")}
        self.path_lengths = json.loads(Path(find("lengths.json")).read_text())

    @staticmethod
    def write(rules: Iterable[tuple[str, str, str]], folder: Path, hashed: Callable[[bytes], int] = digest) -> None:
        """A rule stated twice counts once, and its first verdict holds."""
        verdicts: dict[bytes, str] = {}
        hosts: set[bytes] = set()
        lengths: set[int] = set()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block") or not host or "/" in host or not path.startswith("/"):
                raise ValueError(f"not a rule: {verdict!r} {host!r} {path!r}")
            verdicts.setdefault((host + path).encode(), verdict)
            hosts.add(host.encode())
            lengths.add(len(path))
            if len(verdicts) > MAX_RULES:
                raise ValueError(f"more than {MAX_RULES} rules")
        (folder / "lengths.json").write_text(json.dumps(sorted(lengths)))
        for name, keys in (("hosts", {h: "" for h in hosts}), ("rules", verdicts)):
            ordered = sorted((hashed(k), k, v[:1].encode()) for k, v in keys.items())
            blob = b"".join(k + v for _, k, v in ordered) or b"\0"
            ends = np.cumsum([0] + [len(k) + len(v) for _, k, v in ordered], dtype=np.int64)
            np.save(folder / f"{name}.digests.npy", np.array([d for d, _, _ in ordered], np.uint64))
            np.save(folder / f"{name}.places.npy", ends)
            (folder / f"{name}.strings").write_bytes(blob)

    def find(self, name: str, keys: list[bytes], tail: int) -> list[bytes | None]:
        """The stored string's last ``tail`` bytes (empty for 0) for every key, or None."""
        digests, places, strings = self.parts[name]
        if not keys or not len(digests):
            return [None] * len(keys)
        wanted = np.fromiter((self.hashed(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(digests, wanted)
        hit = np.flatnonzero(digests[np.minimum(at, len(digests) - 1)] == wanted)
        out: list[bytes | None] = [None] * len(keys)
        for i in hit:
            p, key = int(at[i]), keys[i]
            while p < len(digests) and digests[p] == wanted[i]:   # equal digests lie side by side
                stored = strings[places[p]:places[p + 1]].tobytes()
                if stored[:len(stored) - tail] == key:
                    out[i] = stored[len(stored) - tail:]
                    break
                p += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """Rule and verdict of every url, None where no rule fits; the longest rule wins."""
        parents: dict[str, list[str]] = {}
        for host in set(hosts):
            labels = host.split(".")
            parents[host] = [".".join(labels[k:]) for k in range(len(labels))]
        names = sorted({p for ps in parents.values() for p in ps})
        known = {n for n, found in zip(names, self.find("hosts", [n.encode() for n in names], 0), strict=True) if found is not None}
        owner, keys = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for parent in parents[host]:
                if parent in known:
                    for length in self.path_lengths:
                        if length <= len(path):
                            owner.append(i)
                            keys.append(parent + path[:length])
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(hosts)
        for i, key, verdict in zip(owner, keys, self.find("rules", [k.encode() for k in keys], 1), strict=True):
            if verdict is not None and (out[i][0] is None or len(key) > len(out[i][0])):
                out[i] = (key, "allow" if verdict == b"a" else "block")
        return out


def ship_rules(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> str:
    """Write the arrays and have Spark send them to every executor; returns the start of the files' names."""
    folder = Path(tempfile.mkdtemp(prefix="url-rules-")).resolve()
    DigestArray.write(rules, folder)
    for file in list(folder.iterdir()):   # Spark sends no folders beyond one machine
        spark.sparkContext.addFile(str(file.rename(folder / f"{folder.name}-{file.name}")))
    return f"{folder.name}-"


_open: dict[str, DigestArray] = {}


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = DEFAULT,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row; no shuffle, and no other column is read.

    A rule fits its host and all subdomains where the path starts with the rule's path. A url that is
    null or holds no ``://`` has an empty host and path, and no rule fits it. Repeated rows are judged
    alike. An empty table gives no rows, and no rules give the default everywhere.
    """
    name = ship_rules(pages.sparkSession, rules)

    def judged(batches):
        if name not in _open:
            _open.clear()
            _open[name] = DigestArray(lambda file: SparkFiles.get(name + file))
        for batch in batches:
            found = _open[name].judge(batch["host"].to_pylist(), batch["path"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["host"], batch["path"], pa.array([r for r, _ in found], pa.string()),
                 pa.array([v or default for _, v in found], pa.string())], ["page_id", "host", "path", "rule", "verdict"])
    url = F.col(f"`{url_col}`")
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    kind = dict(parts.dtypes)["page_id"]
    return parts.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits"""

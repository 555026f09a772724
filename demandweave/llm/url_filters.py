"""URL filters by a bit-parallel wildcard automaton.

All glob rules lie side by side in masks of 64-bit words, one bit per literal character. One Shift-And step
per URL byte moves every rule at once, and numpy moves every URL of a batch at once. ``*`` keeps its state
alive (a self-loop mask), ``?`` takes any one byte.

The automaton reads ``.host BORDER path``: the border is a byte that UTF-8 never has, so a host pattern
cannot match inside a path. A host rule ``example.org/en/`` is the glob ``*.example.org BORDER /en/*``: the
host itself and all its subdomains. Of the host rules that fit, the longest decides (the first of equals);
where none fits, a URL that fits any of the block globs is blocked and every other allowed.

Defined cases: a null URL, or one without ``://``, has empty host and path; no host rule fits it and it is
allowed unless a glob fits the empty URL. URLs of any length are read whole. Equal rows get equal results,
an empty table an empty one. Other columns pass through; a column that bears an output's name is replaced.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import in_batches, small_batches, with_columns

BORDER = 0xFF
#: (verdict, host rule): the host up to the first slash, then how the path begins.
HOST_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Globs on the host of URLs that no host rule decides.
BLOCK_GLOBS = ("*spam*", "*casino*", "*-bets.*", "*.bets.*", "*porn*", "*adult-*", "*-pills.*", "*ads-track*", "*malware*")


class GlobSet:
    """Masks of a list of byte patterns; in a pattern, ``*`` and ``?`` are None and ``...``."""

    def __init__(self, patterns: list[list]):
        bits = max(1, sum(sum(x is not None for x in p) for p in patterns))
        self.words = (bits + 63) // 64
        self.takes = np.zeros((256, self.words), np.uint64)
        self.first, self.always, self.stays = (np.zeros(self.words, np.uint64) for _ in range(3))
        self.last = []
        at = 0
        for pattern in patterns:
            begun, floating = False, False
            for x in pattern:
                if x is None:
                    if begun:
                        self._set(self.stays, at - 1)
                    else:
                        floating = True
                    continue
                if not begun:
                    self._set(self.first, at)
                    if floating:
                        self._set(self.always, at)
                    begun = True
                for byte in range(255) if x is ... else [x]:
                    self._set(self.takes[byte], at)
                at += 1
            self.last.append(at - 1 if begun else None)  # only stars: fits everything

    @staticmethod
    def _set(mask, bit):
        mask[bit // 64] |= np.uint64(1 << bit % 64)

    def fits(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows by patterns: whether a pattern fits the whole of a row's bytes."""
        lengths = np.diff(ends)
        order = np.argsort(-lengths, kind="stable")
        starts, state = ends[:-1][order], np.zeros((len(order), self.words), np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
        for j, n in enumerate(active.tolist()):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved = (moved & ~self.first) | (self.always if j else self.first)
            state[:n] = (moved & self.takes[data[starts[:n] + j]]) | (now & self.stays)
        out = np.ones((len(order), len(self.last)), bool)
        for k, bit in enumerate(self.last):
            if bit is not None:
                out[order, k] = (state[:, bit // 64] >> np.uint64(bit % 64)) & one > 0
        return out


def glob(text: str) -> list:
    return [{42: None, 63: ...}.get(b, b) for b in text.encode()]


def host_glob(rule: str) -> list:
    host, slash, path = rule.partition("/")
    return [None, *f".{host}".encode(), BORDER, *(slash + path).encode(), None]


def url_parts(url) -> tuple[F.Column, F.Column]:
    """Host and path columns of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, url: str = "url", rules=HOST_RULES, globs=BLOCK_GLOBS) -> DataFrame:
    """``pages`` with host, path, rule (the host rule that decided, else null) and verdict (allow or block)."""
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    blocks = [[*glob(g), BORDER, None] for g in globs]
    automaton = GlobSet([host_glob(text) for _, text in ranked] + blocks)
    names = np.array([text for _, text in ranked] + [None], object)
    said = np.array([verdict for verdict, _ in ranked] + [None], object)

    def run(batches):
        for batch in small_batches(batches, "path"):
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            joined = pa.array([b"." + h.encode() + b"\xff" + p.encode() for h, p in zip(hosts, paths)], pa.binary())
            ends = np.frombuffer(joined.buffers()[1], np.int32).astype(np.int64)
            data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
            fits = automaton.fits(data, ends[: len(hosts) + 1])
            own = fits[:, : len(ranked)]
            best = np.where(own.any(1), own.argmax(1), len(ranked)) if ranked else np.zeros(len(hosts), int)
            blocked = fits[:, len(ranked) :].any(1)
            verdict = np.where(best < len(ranked), said[best], np.where(blocked, "block", "allow"))
            yield with_columns(
                batch, rule=pa.array(names[best], pa.string()), verdict=pa.array(verdict.astype(object), pa.string())
            )

    host, path = url_parts(F.col(url))
    added = {"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit("")}
    pages = pages.withColumns({f"__{k}": v for k, v in added.items()}).drop(*added)
    pages = pages.withColumnsRenamed({f"__{k}": k for k in added})
    return in_batches(pages, run, pages.schema)

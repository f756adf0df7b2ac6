"""URL filters: a bit-parallel wildcard automaton.

Glob rules are packed end to end into the bits of 64-bit words. A Shift-And
step advances every state of every rule over one character, and numpy does the
step for a whole batch of canonical URLs (host and path, end to end) at once.
`*` stands for any run without `/`, `**` for any run.

Nulls: a null URL, or one without `://`, has an empty host and path and can
only match globs of the empty string. URLs of any length are read whole.
Repeated rows get one judgement each. Extra columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters and states held at once.
_CELLS = 4_000_000
_HOST = re.compile(r"://([^/?#]*)([^?#]*)")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class HostRule:
    """Fits a host with its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def rule(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class GlobRule:
    verdict: str
    glob: str


def canonical(url: str | None) -> tuple[str, str]:
    """Host in lower case and path of a URL."""
    m = _HOST.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class GlobAutomaton:
    """All globs at once; matches() says which fit the whole of each string."""

    def __init__(self, globs: Sequence[str]):
        literals, loops, finals, starts, bit = [], [], [], [], 0
        for glob in globs:
            starts.append(bit)
            for part in re.findall(r"\*\*|\*|[^*]", glob):
                if part[0] == "*":
                    loops.append((bit, part))
                else:
                    bit += 1
                    literals.append((bit, part))
            finals.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        known = sorted({ord(c) for _, c in literals} | {ord("/")})
        # class 0: other characters; the last one: behind the end, where all states stay
        self.known = np.array(known, np.uint32)
        n = len(known) + 2
        self.step, self.stay = np.zeros((n, self.words), np.uint64), np.zeros((n, self.words), np.uint64)
        place = {c: k + 1 for k, c in enumerate(known)}
        for at, c in literals:
            self.step[place[ord(c)], at // 64] |= np.uint64(1 << (at % 64))
        for at, part in loops:
            for k in range(n - 1):
                if part == "**" or k != place[ord("/")]:
                    self.stay[k, at // 64] |= np.uint64(1 << (at % 64))
        self.stay[n - 1] = np.uint64(2**64 - 1)
        self.first = np.zeros(self.words, np.uint64)
        for at in starts:
            self.first[at // 64] |= np.uint64(1 << (at % 64))
        self.finals = np.array(finals, np.int64)

    def classes(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.searchsorted(self.known, codes)
        return np.where(self.known[np.minimum(at, len(self.known) - 1)] == codes, at + 1, 0)

    def matches(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean, texts by globs."""
        out = np.zeros((len(texts), len(self.finals)), bool)
        rows, longest = [], 0
        for i in sorted(range(len(texts)), key=lambda i: len(texts[i])):
            longest = max(longest, len(texts[i]))
            if rows and (len(rows) + 1) * (longest + self.words) > _CELLS:
                out[rows] = self._run([texts[k] for k in rows])
                rows = []
            rows.append(i)
        if rows:
            out[rows] = self._run([texts[k] for k in rows])
        return out

    def _run(self, texts: Sequence[str]) -> np.ndarray:
        end, one = len(self.step) - 1, np.uint64(1)
        chars = np.full((max(map(len, texts)), len(texts)), end, np.int64)
        for k, t in enumerate(texts):
            chars[: len(t), k] = self.classes(t)
        state = np.repeat(self.first[None], len(texts), 0)
        for row in chars:
            up = state << one
            up[:, 1:] |= state[:, :-1] >> np.uint64(63)
            state = (up & self.step[row]) | (state & self.stay[row])
        return (state[:, self.finals // 64] >> (self.finals % 64).astype(np.uint64)) & one == 1


class UrlFilter:
    """The longest fitting host rule decides; where none fits, the longest
    fitting glob does, and without one the verdict is allow. Of rules of equal
    length the first given wins."""

    def __init__(self, rules: Sequence[HostRule], globs: Sequence[GlobRule] = ()):
        self.rules = sorted(rules, key=lambda r: -len(r.rule))
        self.globs = sorted(globs, key=lambda g: -len(g.glob.replace("*", "")))
        self.automaton = GlobAutomaton([f"{under}{r.rule}**" for r in self.rules for under in ("", "*.")] + [g.glob for g in self.globs])

    def judge(self, urls: Sequence[str | None]) -> pd.DataFrame:
        parts = [canonical(u) for u in urls]
        hit, n = self.automaton.matches([h + p for h, p in parts]), len(self.rules)
        by_rule = (hit[:, : 2 * n].reshape(-1, n, 2)).any(2)
        by_glob = hit[:, 2 * n :]
        rule = np.where(by_rule.any(1), by_rule.argmax(1), -1) if n else np.full(len(urls), -1)
        glob = np.where(by_glob.any(1), by_glob.argmax(1), -1) if self.globs else np.full(len(urls), -1)
        return pd.DataFrame({
            "host": [h for h, _ in parts], "path": [p for _, p in parts],
            "rule": [self.rules[k].rule if k >= 0 else None for k in rule],
            "glob": [self.globs[k].glob if k >= 0 else None for k in glob],
            "verdict": [self.rules[r].verdict if r >= 0 else self.globs[g].verdict if g >= 0 else "allow" for r, g in zip(rule, glob)],
        })


def filter_urls(df: DataFrame, rules: Sequence[HostRule], globs: Sequence[GlobRule] = (), key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, glob and verdict of each row. Only the two columns
    are read; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast((tuple(rules), tuple(globs)))  # the caller's rules

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = UrlFilter(*shared.value)
        for b in batches:
            out = own.judge([u if isinstance(u, str) else None for u in b["url"]])
            out.insert(0, "key", b["key"].to_numpy())
            yield out

    few = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"))
    kind = few.schema["key"].dataType.simpleString()
    return few.mapInPandas(judge, f"key {kind}, host string, path string, rule string, glob string, verdict string").withColumnRenamed("key", key)

"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once over each canonical URL.

A canonical URL is host + path (host in lower case, no scheme, query or fragment). Globs are anchored at both ends:
`*` stands for any run without `/`, `**` for any run, `?` for one character, all else for itself. Every literal is a
state (a bit); a glob's start is a state too. Bits of all globs lie side by side in 64-bit words:
D' = ((D << 1) & enter[c]) | (D & stay[c]), where stay holds the states that a wildcard follows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (host, path, action): a rule fits its host and all subdomains where the path starts with the rule's; the longest wins.
HOST_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Globs over host + path that are blocked where no host rule speaks.
BLOCK_GLOBS = (
    "*cheap-pills.**", "*spam-farm.**", "*casino*/**", "*poker*/**", "*adult*/**", "*.xxx/**", "*.onion/**",
    "**/login", "**/login/**", "**/signup", "**/signup/**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**/wp-login.*",
    "**/cgi-bin/**", "**/search/**", "**/tag/**/page/**", "**.exe", "**.zip", "**.iso", "**.apk", "**.jpg", "**.png", "**.gif", "**.mp4",
)


@dataclass
class Automaton:
    """Shift-And masks of a list of globs."""

    globs: tuple[str, ...]
    enter: np.ndarray = field(init=False)  # classes x words
    stay: np.ndarray = field(init=False)
    start: np.ndarray = field(init=False)
    final: list[int] = field(init=False)  # the last state of each glob
    known: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        seen = sorted({c for g in self.globs for c in g if ord(c) > 127})
        self.known = {c: 128 + i for i, c in enumerate(seen)}
        classes, states, self.final = 129 + len(seen), [], []
        for g in self.globs:
            states.append((None, False, False))  # where the glob starts; nothing enters it
            i = 0
            while i < len(g):
                if g[i] == "*":
                    both = g.startswith("**", i)
                    last = states[-1]
                    states[-1] = (last[0], True, last[2] or both)
                    i += 1 + both
                else:
                    states.append((g[i], False, False))
                    i += 1
            self.final.append(len(states) - 1)
        words = max(1, -(-len(states) // 64))
        self.enter, self.stay = np.zeros((classes, words), np.uint64), np.zeros((classes, words), np.uint64)
        self.start = np.zeros(words, np.uint64)
        starts = [0, *(f + 1 for f in self.final[:-1])] if self.globs else []
        for s in starts:
            self.start[s // 64] |= np.uint64(1 << s % 64)
        for k, (c, loops, crosses) in enumerate(states):
            w, bit = k // 64, np.uint64(1 << k % 64)
            if c == "?":
                self.enter[:, w] |= bit
            elif c is not None:
                self.enter[ord(c) if ord(c) < 128 else self.known[c], w] |= bit
            if loops:
                self.stay[:, w] |= bit
                if not crosses:
                    self.stay[ord("/"), w] &= ~bit

    def classes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        other = np.flatnonzero(points > 127)
        if len(other):
            points = points.copy()
            points[other] = [self.known.get(text[i], self.enter.shape[0] - 1) for i in other]
        return points

    def run(self, urls: list[str], cells: int = 1 << 20) -> np.ndarray:
        """Whether each url (rows) matches each glob (columns). Works over urls of similar length, side by side."""
        out = np.zeros((len(urls), len(self.globs)), bool)
        order = sorted(range(len(urls)), key=lambda i: len(urls[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * len(urls[order[end]]) <= cells:
                end += 1
            rows = order[at:end]
            lengths = np.array([len(urls[i]) for i in rows])
            grid = np.zeros((len(rows), int(lengths.max())), np.uint32)
            for r, i in enumerate(rows):
                grid[r, : lengths[r]] = self.classes(urls[i])
            d = np.repeat(self.start[None, :], len(rows), 0)
            carry = np.zeros_like(d)
            done = 0
            for p in range(grid.shape[1]):
                while lengths[done] <= p:
                    done += 1  # sorted by length: shorter urls keep their states
                live = d[done:]
                carry[done:, 1:] = live[:, :-1] >> np.uint64(63)
                c = grid[done:, p]
                d[done:] = (((live << np.uint64(1)) | carry[done:]) & self.enter[c]) | (live & self.stay[c])
            for g, f in enumerate(self.final):
                out[rows, g] = (d[:, f // 64] >> np.uint64(f % 64)) & np.uint64(1)
            at = end
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z in lower case. Path: from there up to ? # or the end. Else both are empty."""
    mark = F.instr(url, "://")
    rest = F.coalesce(F.when(mark > 0, F.substr(url, mark + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, host_rules=HOST_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict and the first block glob that matches (glob, else null) for every row of pages.

    Null urls, and those without ://, have an empty host and path: no rule fits and no glob matches, so they are
    allowed. Repeated rows each get a row. Other columns are not read. Of equally long rules the first listed wins.
    """
    rules = sorted(host_rules, key=lambda r: -len(r[0] + r[1]))
    globs = [g for host, path, _ in rules for g in (f"{host}{path}**", f"*.{host}{path}**")] + list(block_globs)
    names, actions, first_block = [h + p for h, p, _ in rules], [a for _, _, a in rules], 2 * len(rules)
    machine = Automaton(tuple(globs))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("glob", T.StringType())]))
    def verdicts(urls: pd.Series) -> pd.DataFrame:
        hit = machine.run(urls.tolist())
        by_rule = hit[:, 0:first_block:2] | hit[:, 1:first_block:2]
        best = np.where(by_rule.any(1), by_rule.argmax(1), -1) if rules else np.full(len(urls), -1)
        block = hit[:, first_block:]
        glob = np.where(block.any(1), block.argmax(1), -1) if block.shape[1] else np.full(len(urls), -1)
        return pd.DataFrame({
            "rule": [names[b] if b >= 0 else None for b in best],
            "verdict": [actions[b] if b >= 0 else ("block" if g >= 0 else "allow") for b, g in zip(best, glob)],
            "glob": [block_globs[g] if g >= 0 else None for g in glob],
        })

    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    return parts.withColumn("v", verdicts(F.concat("host", "path"))).select("page_id", "host", "path", "v.rule", "v.verdict", "v.glob")

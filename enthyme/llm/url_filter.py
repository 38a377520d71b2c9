"""URL filter by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words (Shift-And): a bit per symbol of every rule, a shift per character,
a mask per character class, and self-loops where a wildcard stands. One pass over the characters of a canonical URL runs
all rules at once; NumPy runs it for a batch of URLs together.

A canonical URL is "." + host + path. In a rule, `*` stands for any characters but "/", `**` for any characters, `?` for one
character but "/". A host rule `*.org/**` thus fits org and all its subdomains.

Defined results: a null URL or one without "://" has an empty host and path, which no base rule fits. Repeated rows give
repeated results; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host and the beginning of a path.
BASE_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

#: (glob, verdict) of the method itself, for URLs that no base rule fits; the longest that fits holds, else allow.
OWN_RULES = (
    ("*.ads.**", "block"),
    ("*.adserver.**", "block"),
    ("*.doubleclick.**", "block"),
    ("*.tracking.**", "block"),
    ("*/**/wp-login.php", "block"),
    ("*/login", "block"),
    ("*/**/cart/**", "block"),
    ("*/**/checkout/**", "block"),
    ("**.jpg", "block"),
    ("**.jpeg", "block"),
    ("**.png", "block"),
    ("**.gif", "block"),
    ("**.css", "block"),
    ("**.js", "block"),
    ("**.zip", "block"),
    ("**.exe", "block"),
    ("*.casino.**", "block"),
    ("*.xxx/**", "block"),
)
START, END = "\x02", "\x03"


def base_glob(rule: str) -> str:
    return f"*.{rule}**"


class ShiftAnd:
    """A set of globs as masks of W words of 64 bits."""

    def __init__(self, globs: list[str]) -> None:
        symbols: list[str | None] = []  # None: any character but "/"
        loops: list[str] = []  # what may follow a symbol any number of times
        self.last = []
        for glob in globs:
            symbols.append(START)
            loops.append("")
            i = 0
            while i < len(glob):
                if glob.startswith("**", i):
                    loops[-1], i = "**", i + 2
                elif glob[i] == "*":
                    loops[-1], i = loops[-1] or "*", i + 1
                else:
                    symbols.append(None if glob[i] == "?" else glob[i])
                    loops.append("")
                    i += 1
            symbols.append(END)
            loops.append("")
            self.last.append(len(symbols) - 1)
        letters = sorted({s for s in symbols if s} | {"/", START, END})
        self.codes = {c: k + 1 for k, c in enumerate(letters)}  # class 0: all other characters
        self.words = (len(symbols) + 63) // 64
        self.hit, self.stay = (np.zeros((len(letters) + 1, self.words), dtype=np.uint64) for _ in range(2))
        self.first = np.zeros(self.words, dtype=np.uint64)
        for k, (symbol, loop) in enumerate(zip(symbols, loops, strict=True)):
            w, bit = k // 64, np.uint64(1 << (k % 64))
            if symbol == START:
                self.first[w] |= bit
            for c, code in [("", 0), *self.codes.items()]:
                if symbol == c or symbol is None and c not in ("/", START, END):
                    self.hit[code, w] |= bit
                if c not in (START, END) and (loop == "**" or loop == "*" and c != "/"):
                    self.stay[code, w] |= bit
        self.points = np.array([ord(c) for c in letters], dtype=np.uint32)  # ascending, as the codes are

    def classes(self, url: str) -> np.ndarray:
        points = np.frombuffer((START + url.replace(START, " ").replace(END, " ") + END).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)

    def run(self, urls: list[str]) -> np.ndarray:
        """A boolean for each URL and glob."""
        out = np.zeros((len(urls), len(self.last)), dtype=bool)
        rows = [self.classes(u) for u in urls]
        order = sorted(range(len(urls)), key=lambda i: -len(rows[i]))
        at = 0
        while at < len(order):
            longest = len(rows[order[at]])
            part = order[at : at + max(1, 4_000_000 // longest)]
            at += len(part)
            lengths = np.array([len(rows[i]) for i in part])
            grid = np.zeros((longest, len(part)), dtype=np.int64)
            for k, i in enumerate(part):
                grid[: lengths[k], k] = rows[i]
            state = np.zeros((len(part), self.words), dtype=np.uint64)
            for step in range(longest):
                n = int(np.searchsorted(-lengths, -step, side="left"))  # those with more than `step` characters
                d = state[:n]
                moved = d << np.uint64(1)
                moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
                code = grid[step, :n]
                state[:n] = ((moved | self.first) & self.hit[code]) | (d & self.stay[code])
            for g, k in enumerate(self.last):
                out[part, g] = (state[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) != 0
        return out


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", base=BASE_RULES, own=OWN_RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the longest base rule that fits, else null), verdict, own_rule (the glob that decided)."""
    base = sorted(base, key=lambda r: (-len(r[0]), r[0]))
    own = sorted(own, key=lambda r: (-len(r[0]), r[0]))
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
    parts = parts.selectExpr("page_id", "if(instr(u, '://') > 0, substring(u, instr(u, '://') + 3), '') AS rest")
    host = F.translate(F.regexp_extract("rest", r"\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = parts.select("page_id", host.alias("host"), F.regexp_extract("rest", r"\A[^/?#]*([^?#]*)", 1).alias("path"))
    schema = "page_id long, host string, path string, rule string, verdict string, own_rule string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([base_glob(r) for r, _ in base] + [g for g, _ in own])
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            fits = automaton.run([f".{h}{p}" if h or p else "" for h, p in zip(hosts, paths, strict=True)])
            first = np.argmax(np.concatenate([fits[:, : len(base)], np.ones((len(hosts), 1), dtype=bool)], axis=1), axis=1)
            second = np.argmax(np.concatenate([fits[:, len(base) :], np.ones((len(hosts), 1), dtype=bool)], axis=1), axis=1)
            rules = [base[k][0] if k < len(base) else None for k in first]
            owns = [own[k][0] if r is None and k < len(own) else None for k, r in zip(second, rules, strict=True)]
            verdicts = [base[k][1] if k < len(base) else own[j][1] if j < len(own) else default for k, j in zip(first, second, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(owns, pa.string())], ["page_id", "host", "path", "rule", "verdict", "own_rule"])

    return parts.mapInArrow(judge, schema)


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        else:
            out, i = out + ("[^/]" if glob[i] == "?" else glob[i] if glob[i].isalnum() or glob[i] in "/-_" else "\\" + glob[i]), i + 1
    return out


def oracle(base=BASE_RULES, own=OWN_RULES, default: str = "allow") -> str:
    cases, verdicts, owns = "", "", ""
    for rule, verdict in sorted(base, key=lambda r: -len(r[0])):
        h, _, p = rule.partition("/")
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}')"
        cases += f" WHEN {fits} THEN '{rule}'"
        verdicts += f" WHEN rule = '{rule}' THEN '{verdict}'"
    for glob, verdict in sorted(own, key=lambda r: (-len(r[0]), r[0])):
        fits = f"rule IS NULL AND host || path <> '' AND regexp_full_match('.' || host || path, '{_regex(glob)}', 's')"
        verdicts += f" WHEN {fits} THEN '{verdict}'"
        owns += f" WHEN {fits} THEN '{glob}'"
    return f"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (SELECT *, CASE{cases} ELSE NULL END AS rule FROM p)
SELECT page_id, host, path, rule, CASE{verdicts} ELSE '{default}' END AS verdict, CASE{owns} ELSE NULL END AS own_rule FROM r
"""

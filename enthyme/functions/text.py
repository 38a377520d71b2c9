"""Text functions as Columns: all but the FNV-1a hash run inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what each is read as; marks that are dropped.
QUOTES_FROM, QUOTES_TO = "‘’‚‛′“”„″«»‐‑‒–—―− ", "'''''\"\"\"\"\"\"------- "
DROPPED = "*_`\\­"
PAGE_MARKER = r"<!--\s*(?:[^\n]*?\s)?p\.\s*\d+\s+begins here\s*-->"
SPACE = r"[ \t\n\r\f]+"

# Words that say nothing of what a claim is about.
STOP_WORDS = (
    "the a an of and or to in is are be that this it as for with on by not but its which what who "
    "whom whose can could would should may might must will shall do does did have has had from at "
    "than then so if we our they their them there here about into over under more most less least "
    "such no nor only own same too very just also one two both each any all some other others being "
    "been was were"
).split()


def as_in_sql(pattern: str) -> str:
    """A pattern read as SQL reads it: a word boundary parts ASCII letters, digits and _ from all else, and white space is without the vertical
    tab. Java takes accented letters for letters at a boundary, or not, by its version. No escape for white space may stand in a class."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))").replace(r"\s", r"[ \t\n\f\r]")


def normalise(text: Column) -> Column:
    """Folds what does not matter when a quotation is looked up: quotes, dashes, ellipses, emphasis, page markers, runs of
    white space."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), PAGE_MARKER, " ")
    text = F.translate(text, QUOTES_FROM + DROPPED, QUOTES_TO)
    return F.regexp_replace(F.replace(text, F.lit("…"), F.lit("...")), SPACE, " ")


def folded(text: Column) -> Column:
    return F.trim(F.lower(normalise(text)))


def quote_parts(quote: Column) -> Column:
    """A quotation cut at its elisions; parts under four characters are dropped."""
    q = F.regexp_replace(F.trim(normalise(quote)), r"\.{3,} *$", "")
    return F.filter(F.transform(F.split(q, r" *\.{3,} *"), lambda p: F.trim(p)), lambda p: F.length(p) >= 4)


def content_words(text: Column) -> Column:
    """Lower-case words of four letters or more, without stop words."""
    long_stops = [w for w in STOP_WORDS if len(w) >= 4]
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{4,})"), 1), lambda w: ~w.isin(long_stops))


def recall(want: Column, have: Column) -> Column:
    """The share of the words of `want`, with repeats, that `have` holds; null if it has none."""
    return F.size(F.filter(want, lambda w: F.array_contains(have, w))) / F.nullif(F.size(want), F.lit(0))


def sentences(text: Column, least: int = 30) -> Column:
    """Sentences of at least that many characters."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), "(?<=[.!?])[\"”’)]?\\s+(?=[A-Z“\"(])")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda s: F.length(s) >= least)


def verbatim(quote: Column, source: Column, least: int = 30) -> Column:
    """True, false, or null where the words are too few to tell."""
    q = folded(quote)
    return F.when(F.length(q) >= least, F.contains(folded(source), q))


def fnv1a(text: Column) -> Column:
    """FNV-1a of 32 bits over the UTF-16 code units, as eight hex digits. Each step needs the one before, so a batch of texts goes unit by unit
    together, the longest first; a text that has ended drops out."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        units = [np.frombuffer((t or "").encode("utf-16-le", "surrogatepass"), dtype="<u2") for t in texts]
        order = sorted(range(len(units)), key=lambda i: -len(units[i]))
        sizes = np.array([len(units[i]) for i in order], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        flat = np.concatenate([units[i] for i in order]).astype(np.uint32) if order else np.empty(0, np.uint32)
        h = np.full(len(order), 2166136261, dtype=np.uint32)
        alive = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if order else 0) + 1), side="right")  # texts with a unit at each place
        for k, n in enumerate(alive.tolist()):
            h[:n] = (h[:n] ^ flat[begins[:n] + k]) * np.uint32(16777619)
        out = [""] * len(order)
        for place, i in enumerate(order):
            out[i] = f"{h[place]:08x}"
        return pd.Series(out, index=texts.index)

    return run(text)


def stamp(text: Column) -> Column:
    """The fingerprint of a text with case and white space folded."""
    return fnv1a(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " ")))


def pinned_pages(pinpoint: Column) -> Column:
    """The pages that `p. 34`, `pp. 30, 34` or `pp. 30-34` name, ascending."""
    listed = F.regexp_extract(F.coalesce(pinpoint, F.lit("")), r"pp?\.\s*([0-9][0-9,\s–-]*)", 1)
    spans = F.filter(F.split(listed, ","), lambda s: F.trim(s) != "")
    ends = F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit("([0-9]+)"), 1))
    pages = F.transform(F.filter(ends, lambda e: F.size(e) > 0), lambda e: F.sequence(e[0].cast("int"), F.greatest(e[0].cast("int"), F.element_at(e, -1).cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(pages)))


# Words that announce a cause.
CAUSAL = (
    r"\b(because|therefore|thereby|consequently|as a result|hence|"
    r"results? in|resulted in|resulting in|leads? to|led to|leading to|"
    r"causes?|caused|causing|due to|owing to|"
    r"drives?|driven|driving|reduces?|reduced|reducing|increases?|increased|increasing|"
    r"raises?|raised|raising|lowers?|lowered|lowering|prevents?|prevented|preventing|"
    r"contributes? to|contributed to|contributing to|so that|in order to|"
    r"enables?|enabled|enabling|encourages?|encouraged|encouraging|"
    r"deters?|deterred|deterring|discourages?|discouraged|"
    r"promotes?|promoted|promoting|undermines?|undermined|undermining|"
    r"more likely|less likely|effects? of|impacts? on|in turn)\b"
)


def causal_mentions(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(as_in_sql(CAUSAL)), 1))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def link_ratio(html: Column) -> Column:
    """The share of the characters of text that stand in links."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    linked = F.array_join(F.regexp_extract_all(body, F.lit(r"(?is)<a[ >][^>]*>?(.*?)</a>"), 1), "")
    plain = lambda t: F.length(F.regexp_replace(t, "<[^>]*>", ""))
    return F.when(plain(body) > 0, plain(linked) / plain(body)).otherwise(0.0)


# How a line of a publisher's apparatus begins or what it holds.
APPARATUS = r"(?i)(licensed under|this work is licensed|all rights reserved|©|creative commons|general public license|apache license|mit license)"


def is_apparatus(line: Column) -> Column:
    return F.regexp_like(line, F.lit(APPARATUS))

"""Where quotations stand in their sources, and what they were cut away from.

Texts are compared folded: typographic marks, emphasis, page markers and white space don't matter, and each line folds by itself. The offset map
of a source is the table of its lines with the characters of the folded text that they hold, from cumulative lengths; an
offset is turned into a line by an interval join. Case is kept for what is shown and dropped for what is compared.

Defined results: a null text is empty; quotations under `least` characters are not looked up; of occurrences that overlap each other the first
counts. A page marker stands in one line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_words, folded, normalise, quote_parts
from ..plans.tables import materialised, small
from .lines import source_lines

# Words and phrases by which the rest of a sentence corrects what came before.
CORRECTIVE = "or but whereas although though yet however rather instead unless except nevertheless nonetheless albeit conversely not never no".split()
CORRECTIVE_PHRASES = (
    "more coarsely", "more clearly", "more precisely", "more exactly", "more accurately", "that is", "in fact", "in truth", "at least", "on the contrary", "strictly speaking", "to be precise", "properly speaking", "or rather",
)
# Words before a quotation whose loss changes what was claimed.
LEADING_HEDGES = (
    "some many most few several certain sometimes often usually typically generally occasionally perhaps maybe arguably seemingly "
    "apparently allegedly supposedly nearly almost roughly largely mostly partly possibly probably might may could seems appears "
    "not never hardly rarely seldom"
).split()
# Words of a claim that no source need hold, and endings that don't make another word.
GLOSS_STOP = (
    "those these thereby therefore thus hence whether while when where moreover further furthermore "
    "itself himself herself themselves oneself upon without within against among between during "
    "again still even quite rather already always never ever perhaps indeed however nonetheless "
    "cannot shall must ought given makes make made take taken gives given goes come comes case cases "
    "thing things point points way ways part parts kind kinds sort sorts terms sense means"
).split()
ENDINGS = "ations ation ingly ising izing ments ment ions ion ings ing edly ies ied ers er est ally ly es ed s".split()
#: The widest elision that passes without a word, and how much of what follows is shown.
MAX_ELISION, SHOWN = 200, 160
#: Claims under this length are not taken for the author's words.
MIN_VERBATIM = 30

SENTENCE_END = "[.!?][\"')\\]]*"
LAST_END = f"^(.*{SENTENCE_END})(?: |$)"
FIRST_END = f"^(.*?{SENTENCE_END})(?: |$)"


def shaped(text: Column) -> Column:
    """Folded, with its case: as long as its lower-case form."""
    return F.trim(F.translate(normalise(text), "İ", "I"))


def folded_lines(lines: DataFrame) -> DataFrame:
    """(source_id, line, begin, end, block) of lines (source_id, line, raw) that fold to something: the characters they hold in the folded source,
    from 1, the end not included. Headings and blank lines part blocks; a heading is one of its own."""
    heading = F.regexp_like("raw", F.lit("^#{1,6} "))
    t = lines.select("source_id", "line", F.length(shaped(F.col("raw"))).alias("n"), heading.alias("heading"), (F.trim("raw") == "").alias("blank"))
    w = Window.partitionBy("source_id").orderBy("line")
    before = F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    after = F.lag("heading", 1, False).over(w)
    block = F.sum(F.when(F.col("heading") | F.col("blank") | after, 1).otherwise(0)).over(w)
    return t.select("source_id", "line", before.cast("int").alias("begin"), (before + F.col("n")).cast("int").alias("end"), block.alias("block"), "n").filter("n > 0").drop("n")


def starts_of(part: Column, body: Column) -> Column:
    """Where a part begins in a body, ascending."""
    pieces = F.split(body, F.concat(F.lit("\\Q"), part, F.lit("\\E")), -1)  # a folded text has no backslash
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + F.length(x) + F.length(part)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(x) + 1).alias("out"))
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), none, step)["out"]


def spans_from(start: Column, parts: Column, body: Column) -> Column:
    """The places of all parts, each after the one before, the first at start; fewer places than parts if one is missing."""

    def following(acc: Column, part: Column) -> Column:
        at = F.position(part, body, F.element_at(acc, -1)["end"])
        return F.when(at > 0, F.array_append(acc, F.struct(at.alias("begin"), (at + F.length(part)).alias("end")))).otherwise(acc)

    first = F.array(F.struct(start.alias("begin"), (start + F.length(parts[0])).alias("end")))
    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), first, following)


def lowered_parts(text: Column) -> Column:
    return F.transform(quote_parts(text), lambda p: F.lower(F.translate(p, "İ", "I")))


def occurring(pairs: DataFrame) -> DataFrame:
    """Pairs (..., parts, body) with nth and spans, a row for each occurrence of the first part that the others follow."""
    low = F.lower("body")
    rows = pairs.withColumn("low", low).filter(F.contains("low", F.col("parts")[0]))
    rows = rows.select("*", F.posexplode(starts_of(F.col("parts")[0], F.col("low"))).alias("nth", "start"))
    rows = rows.withColumn("spans", spans_from(F.col("start"), F.col("parts"), F.col("low")))
    return rows.filter(F.size("spans") == F.size("parts")).withColumn("nth", F.col("nth") + 1).drop("low", "start")


def occurrences(quotes: DataFrame, sources: DataFrame, q: str = "item_id", s: str = "doc_id", text: str = "text", least: int = 10) -> DataFrame:
    """(quote_id, source_id, nth, spans, body): every place where all parts of a quotation with elisions stand in order. Candidates hold the
    longest inner word of its longest part."""
    asked = quotes.select(F.col(q).alias("quote_id"), lowered_parts(F.col(text)).alias("parts")).filter(F.size("parts") > 0)
    longest = F.array_max(F.transform("parts", lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    words = F.split(longest, " ")
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)).otherwise(words)
    word = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = asked.select("quote_id", "parts", word.alias("anchor"), F.size(words).alias("n_words"), F.length(longest).alias("size")).filter(F.col("size") >= least)
    body = materialised(sources.select(F.col(s).alias("source_id"), shaped(F.col(text)).alias("body")))  # folded once, read three times
    held = body.select("source_id", F.explode(F.array_distinct(F.split(F.lower("body"), " "))).alias("anchor"))
    near = held.join(small(asked.filter("n_words > 2")), "anchor").select("quote_id", "source_id", "parts")
    short = small(asked.filter("n_words <= 2")).select("quote_id", "parts")  # nothing inside to join on: each text is searched
    pairs = body.join(near, "source_id").unionByName(body.join(short, F.contains(F.lower("body"), F.col("parts")[0])))
    return occurring(pairs).select("quote_id", "source_id", "nth", "spans", "body")


def lines_held(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(quote_id, source_id, nth, first_line, last_line): the lines that an occurrence touches at either end."""
    at = found.select("quote_id", "source_id", "nth", F.col("spans")[0]["begin"].alias("a"), (F.element_at("spans", -1)["end"] - 1).alias("z"))
    touched = at.join(folded_lines(lines.join(small(at.select("source_id").distinct()), "source_id", "left_semi")), "source_id").filter("begin <= z AND end > a")
    return touched.groupBy("quote_id", "source_id", "nth").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"))


def stem(word: Column) -> Column:
    """A word without an ending, where three letters stay."""
    return F.regexp_replace(word, f"^(.{{3,}}?)({'|'.join(ENDINGS)})$", "$1")


def absent_terms(claims: DataFrame, sources: DataFrame, c: str = "item_id", s: str = "doc_id", text: str = "text") -> DataFrame:
    """(claim_id, source_id, terms) of pairs: claims (c, s, text) and the words of a claim, longest first, that its source has in no form."""
    said = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(^|\s)#[A-Za-z][\w-]*", " ")
    asked = claims.select(F.col(c).alias("claim_id"), F.col(s).alias("source_id"), F.array_distinct(content_words(said)).alias("words"))
    have = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(shaped(F.col(text))), F.lit("([a-z]{4,})"), 1), stem))
    rows = asked.join(sources.select(F.col(s).alias("source_id"), have.alias("have")), "source_id")
    gone = F.filter("words", lambda w: ~w.isin(GLOSS_STOP) & ~F.array_contains("have", stem(w)))
    ordered = F.transform(F.array_sort(F.transform(gone, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return rows.select("claim_id", "source_id", F.array_join(ordered, ",").alias("terms"))


def quotation_context(found: DataFrame, lines: DataFrame) -> DataFrame:
    """For each occurrence the sentences at its outer edges and what was left out of them: `dropped`, a hedge right before it; `continues`, the rest of the
    sentence where it corrects; `complete`, whether nothing but punctuation follows; `gap`, the widest elision over MAX_ELISION."""
    blocks = folded_lines(lines.join(small(found.select("source_id").distinct()), "source_id", "left_semi")).groupBy("source_id", "block").agg(F.min("begin").alias("low"), F.max("end").alias("high"))
    blocks = blocks.drop("block")
    begins = lambda k: F.element_at("spans", k)["begin"]
    ends = lambda k: F.element_at("spans", k)["end"]
    rows = found
    for k, name in ((1, "a"), (-1, "z")):
        held = blocks.select("source_id", F.col("low").alias(f"{name}_low"), F.col("high").alias(f"{name}_high"))
        rows = rows.join(held, "source_id").filter((F.col(f"{name}_low") <= begins(k)) & (begins(k) < F.col(f"{name}_high")))
    piece = lambda a, b: F.substring(F.col("body"), a, b - a)
    for k, name in ((1, "a"), (-1, "z")):
        low, high = F.col(f"{name}_low"), F.greatest(F.col(f"{name}_high"), ends(k))
        opening = F.length(F.regexp_extract(piece(low, begins(k)), LAST_END, 1))
        closing = F.length(F.regexp_extract(piece(ends(k) - 1, high), FIRST_END, 1))
        rows = rows.withColumn(f"{name}_start", low + opening).withColumn(f"{name}_end", F.when(closing > 0, ends(k) - 1 + closing).otherwise(high))
    head, tail = piece(F.col("a_start"), begins(1)), piece(ends(-1), F.col("z_end"))
    last = F.lower(F.regexp_extract(head, "([A-Za-z']+)[^A-Za-z']*$", 1))
    rest = F.regexp_replace(F.ltrim(tail), r"^[,;:-]+ *", "")
    opens = F.lower(F.regexp_extract(rest, "^([A-Za-z']+)", 1))
    turns = opens.isin(CORRECTIVE)
    for phrase in CORRECTIVE_PHRASES:
        turns = turns | F.startswith(F.lower(rest), F.lit(phrase))
    gaps = F.transform(F.sequence(F.lit(2), F.size("spans")), lambda k: F.element_at("spans", k)["begin"] - F.element_at("spans", k - 1)["end"])
    gap = F.when(F.size("spans") > 1, F.array_max(gaps)).otherwise(0)
    same = (F.col("a_start") == F.col("z_start")) & (F.col("a_end") == F.col("z_end"))
    return rows.select(
        "quote_id",
        "source_id",
        "nth",
        F.trim(piece(F.col("a_start"), F.col("a_end"))).alias("sentence"),
        F.when(~same, F.trim(piece(F.col("z_start"), F.col("z_end")))).alias("sentence_last"),
        F.left(F.trim(piece(F.col("z_end"), F.col("z_high"))), F.lit(SHOWN)).alias("after"),
        (F.regexp_replace(tail, r"""[ .,;:!?"')\]]+""", "") == "").alias("complete"),
        F.when(last.isin(LEADING_HEDGES), last).alias("dropped"),
        F.when(turns, rest).alias("continues"),
        F.when(gap > MAX_ELISION, gap).otherwise(0).alias("gap"),
    )

"""Reader of argument maps in the plain-text notation: one file, many typed rows.

Read: `[Title]: text` statements, `<Title>: text` arguments, relations by arrows on indented lines, premise-conclusion structures
((1), (2), `----` or `-- rule --`), `#tags`, `{...}` metadata in flow form, `#` headings, comments, and the front matter
between `===` lines. What can't be read becomes a row of kind `fault` with its line; no file stops the others.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "map_id string, kind string, line int, body string"
ELEMENT = r"(?:\[(?P<s>[^\]]+)\]|<(?P<a>[^>]+)>)"
NODE = re.compile(rf"^(?P<indent>\s*)(?:(?P<arrow><\+|<-|<_|\+>|->|_>|><|\+|-|_)\s+)?{ELEMENT}(?P<colon>\s*:\s*(?P<text>.*))?\s*$")
PCS = re.compile(rf"^\s*\((?P<n>\d+)\)\s*(?:{ELEMENT}\s*:?\s*)?(?P<text>.*)$")
RULE = re.compile(r"^\s*(?:-{4,}|--\s*(?P<rule>.*?)\s*--)\s*$")
TAG = re.compile(r"(?<!\S)#(?:\(([^)]+)\)|([A-Za-z][\w-]*))")
#: What an arrow says of the line's element and the one it hangs from: (type, whether the element is the source).
ARROWS = {"+>": ("support", False), "->": ("attack", False), "_>": ("undercut", False), "><": ("contradictory", False), "+": ("support", True), "<+": ("support", True), "-": ("attack", True), "<-": ("attack", True), "_": ("undercut", True), "<_": ("undercut", True)}


def flow(text: str):
    """A value of the flow form of YAML: {k: v}, [v], quoted or plain scalars."""
    at = 0

    def skip() -> None:
        nonlocal at
        while at < len(text) and text[at] in " \t\r\n":
            at += 1

    def scalar(stops: str):
        nonlocal at
        if at < len(text) and text[at] in "\"'":
            quote, end = text[at], at + 1
            while end < len(text) and text[end] != quote:
                end += 2 if quote == '"' and text[end] == "\\" else 1
            if end >= len(text):
                raise ValueError("a quotation mark is not closed")
            out, at = text[at + 1 : end], end + 1
            return out.replace('\\"', '"') if quote == '"' else out
        end = at
        while end < len(text) and text[end] not in stops and not (text[end] == ":" and ":" in stops and (end + 1 == len(text) or text[end + 1] in " \t\n")):
            end += 1
        word, at = text[at:end].strip(), end
        if word in ("true", "false"):
            return word == "true"
        if word in ("", "null", "~"):
            return None
        return int(word) if re.fullmatch(r"-?\d+", word) else float(word) if re.fullmatch(r"-?\d+\.\d+", word) else word

    def value(stops: str):
        nonlocal at
        skip()
        if at < len(text) and text[at] in "{[":
            shut, is_map = ("}", True) if text[at] == "{" else ("]", False)
            at += 1
            items: list = []
            while True:
                skip()
                if at >= len(text):
                    raise ValueError(f"`{shut}` is missing")
                if text[at] == shut:
                    at += 1
                    return dict(items) if is_map else items
                if text[at] == ",":
                    at += 1
                    continue
                if not is_map:
                    items.append(value(",]"))
                    continue
                key = str(scalar(":,}"))
                skip()
                if at < len(text) and text[at] == ":":
                    at += 1
                    if key in dict(items):
                        raise ValueError(f"`{key}` is given twice")
                    items.append((key, value(",}")))
                else:
                    items.append((key, None))
        return scalar(stops)

    out = value("")
    skip()
    if at < len(text):
        raise ValueError(f"`{text[at : at + 12]}` is left over")
    return out


def block(lines: list[str]) -> dict:
    """The block form, as far as front matter uses it: nested maps by indentation, lists with -, flow values."""
    rows = [(len(x) - len(x.lstrip()), x.strip()) for x in lines if x.strip() and not x.strip().startswith("#")]
    at = 0

    def level(indent: int):
        nonlocal at
        out: dict | list | None = None
        while at < len(rows) and rows[at][0] >= indent:
            depth, text = rows[at]
            if depth > indent:
                raise ValueError(f"`{text[:20]}` is indented too far")
            at += 1
            if text.startswith("- "):
                out = [] if out is None else out
                out.append(flow(text[2:]))
                continue
            key, colon, rest = text.partition(":")
            if not colon:
                raise ValueError(f"`{text[:20]}` is no key")
            out = {} if out is None else out
            key = key.strip().strip("\"'")
            if key in out:
                raise ValueError(f"`{key}` is given twice")
            nested = at < len(rows) and rows[at][0] > depth
            out[key] = flow(rest) if rest.strip() else level(rows[at][0]) if nested else None
        return out

    return level(rows[0][0]) if rows else {}


def parse(text: str) -> Iterator[tuple[str, int, dict]]:
    """(kind, line, body) rows of one map."""
    lines = re.sub(r"/\*.*?\*/|<!--.*?-->", lambda m: "\n" * m[0].count("\n"), text or "", flags=re.S).split("\n")
    at, section = 0, None
    fences = [i for i, x in enumerate(lines) if re.fullmatch(r"={3,}\s*", x)]
    if len(fences) >= 2 and not any(x.strip() and not x.strip().startswith("//") for x in lines[: fences[0]]):
        try:
            yield "front", fences[0] + 1, block(lines[fences[0] + 1 : fences[1]])
        except ValueError as e:
            yield "fault", fences[0] + 1, {"message": str(e)}
        at = fences[1] + 1
    stack: list[tuple[int, str, str]] = []  # indent, type, title
    argument: str | None = None
    step, premises, last, names = 0, [], None, 0
    while at < len(lines):
        raw = re.sub(r"(?<!:)//.*$", "", lines[at])
        number, at = at + 1, at + 1
        if not raw.strip():
            stack = []
            continue
        if m := re.match(r"^(#+)\s+(.*)$", raw):
            section = m[2].strip()
            yield "section", number, {"level": len(m[1]), "title": section}
            argument = None
            continue
        if raw.strip().startswith("{") and last:
            begin = number
            body = raw
            while body.count("{") > body.count("}") and at < len(lines):
                body += "\n" + lines[at]
                at += 1
            try:
                yield "data", begin, {"title": last[1], "type": last[0], "data": flow(body.strip())}
            except ValueError as e:
                yield "fault", begin, {"message": str(e), "title": last[1]}
            continue
        if (m := RULE.match(raw)) and argument:
            step += 1
            yield "rule", number, {"argument": argument, "step": step, "rule": m["rule"] or None}
            continue
        if m := PCS.match(raw):
            title = m["s"] or f"{argument or 'untitled'} ({m['n']})"
            last = ("statement", title)
            yield "pcs", number, {"argument": argument, "n": int(m["n"]), "title": title, "step": step, "concludes": step > len(premises)}
            if step > len(premises):
                premises.append(title)
            if m["text"].strip() or m["s"]:
                yield "statement", number, {"title": title, "text": TAG.sub("", m["text"]).strip(), "tags": [a or b for a, b in TAG.findall(m["text"])], "section": section}
            continue
        if m := NODE.match(raw):
            kind, title = ("statement", m["s"]) if m["s"] else ("argument", m["a"])
            indent = len(m["indent"])
            stack = [x for x in stack if x[0] < indent]
            body = m["text"] or ""
            while at < len(lines) and lines[at].strip() and not re.match(rf"^\s*(?:[{{(#]|-{{2,}}|(?:(?:<\+|<-|<_|\+>|->|_>|><|\+|-|_)\s+)?{ELEMENT})", lines[at]):
                body += " " + lines[at].strip()
                at += 1
            yield kind, number, {"title": title, "text": TAG.sub("", body).strip(), "tags": [a or b for a, b in TAG.findall(body)], "section": section}
            if m["arrow"] and stack:
                relation, inward = ARROWS[m["arrow"]]
                here, there = (title, kind), (stack[-1][2], stack[-1][1])
                src, dst = (here, there) if inward else (there, here)
                yield "relation", number, {"src": src[0], "src_type": src[1], "dst": dst[0], "dst_type": dst[1], "type": relation}
            stack.append((indent, kind, title))
            last = (kind, title)
            if kind == "argument" and not indent:
                argument, step, premises = title, 0, []
            continue
        names += 1
        last = ("statement", f"Untitled {names}")
        yield "statement", number, {"title": last[1], "text": TAG.sub("", raw).strip(), "tags": [a or b for a, b in TAG.findall(raw)], "section": section}


def rows(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """All rows of all maps: (map_id, kind, line, body as JSON)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(k, kind, line, json.dumps(body)) for k, t in zip(f["map_id"], f["text"], strict=True) for kind, line, body in parse(t)]
            yield pd.DataFrame(out, columns=["map_id", "kind", "line", "body"])

    return files.select(F.col(key).cast("string").alias("map_id"), F.col(text).alias("text")).mapInPandas(run, ROW)


def read(spark: SparkSession, path: str) -> DataFrame:
    return rows(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def _typed(parsed: DataFrame, kind: str, schema: str) -> DataFrame:
    return parsed.filter(F.col("kind") == kind).select("map_id", "line", F.from_json("body", schema).alias("b")).select("map_id", "line", "b.*")


def claims(parsed: DataFrame) -> DataFrame:
    """(map_id, title, text, tags, section, line): statements merged over their mentions, the first text that is given."""
    s = _typed(parsed, "statement", "title string, text string, tags array<string>, section string")
    said = F.when(F.col("text") != "", F.struct("line", "text", "section"))
    return s.groupBy("map_id", "title").agg(F.min(said).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.min("line").alias("line")).select("map_id", "title", "m.text", "tags", "m.section", "line")


def arguments(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "argument", "title string, text string, tags array<string>, section string").groupBy("map_id", "title").agg(F.max("text").alias("text"), F.min("line").alias("line"))


def relations(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "relation", "src string, src_type string, dst string, dst_type string, type string").drop("line").distinct()


def pcs_lines(parsed: DataFrame) -> DataFrame:
    """(map_id, arg, n, role, title, step, rule): the last conclusion of an argument is its main one."""
    p = _typed(parsed, "pcs", "argument string, n int, title string, step int, concludes boolean")
    rule = _typed(parsed, "rule", "argument string, step int, rule string").select("map_id", "argument", "step", "rule")
    last = p.groupBy("map_id", "argument").agg(F.max("n").alias("top"))
    role = F.when(~F.col("concludes"), "premise").when(F.col("n") == F.col("top"), "main-conclusion").otherwise("intermediary-conclusion")
    key = ["map_id", "argument"]
    return p.join(last, key).join(rule, [*key, "step"], "left").select("map_id", F.col("argument").alias("arg"), "n", role.alias("role"), "title", "step", F.when(F.col("concludes"), F.col("rule")).alias("rule"))


def faults(parsed: DataFrame) -> DataFrame:
    return _typed(parsed, "fault", "message string, title string")


def title_edges(parsed: DataFrame) -> DataFrame:
    """(map_id, src, dst, kind) between claims: relations, with an argument standing for its main conclusion (or for itself if it has
    none), and the steps of its structure: premises since the last conclusion, and that conclusion, support the next."""
    p = pcs_lines(parsed)
    main = p.filter("role = 'main-conclusion'").select("map_id", F.col("arg").alias("name"), F.col("title").alias("stands"))
    r = relations(parsed)
    for end in ("src", "dst"):
        m = main.select("map_id", F.col("name").alias(end), F.lit("argument").alias(f"{end}_type"), F.col("stands").alias(f"{end}_stands"))
        r = r.join(m, ["map_id", end, f"{end}_type"], "left").withColumn(end, F.coalesce(f"{end}_stands", end)).drop(f"{end}_stands")
    own = r.select("map_id", "src", "dst", F.col("type").alias("kind"))
    conclusions = p.filter("role <> 'premise'").select("map_id", "arg", "step", F.col("title").alias("dst"))
    used = p.filter("role = 'premise'").select("map_id", "arg", (F.col("step") + 1).alias("step"), F.col("title").alias("src"))
    carried = conclusions.select("map_id", "arg", (F.col("step") + 1).alias("step"), F.col("dst").alias("src"))
    steps = used.unionByName(carried).join(conclusions, ["map_id", "arg", "step"]).select("map_id", "src", "dst", F.lit("support").alias("kind"))
    return own.unionByName(steps).filter("src <> dst").distinct()

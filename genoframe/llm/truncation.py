"""Text cut off by field limits (problem 9).

Two looks at each text, in one pass over the texts. The first is the self-join by prefix:
texts of any length that are strict prefixes of longer ones elsewhere, by hashes of prefixes
of fixed lengths (a grid that doubles; below it every length that occurs) and settled by the
hash of exactly the shorter one's length; it counts if the longer text goes on within the
line that the shorter one ends in. Where a cut text has no longer copy that join can't see
it, so the second look reads the text's end: what language it is, and whether it ends
inside a literal, a comment, a statement or a sentence or with a bracket or block open.
Either one makes a case, and ``found_by`` says which.

Cases:

* null, empty and blank texts are not cut, and are no prefixes.
* repeated texts are judged alike; ids don't take part, so null and repeated ids are reported
  as they are, each (id, source) once.
* a byte-order mark and closing blanks don't count for the end; an ellipsis put after it is
  looked behind, and what stands before it decides.
* an empty table gives no rows; a null source is a source.
"""

from __future__ import annotations

import ast
import keyword
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoframe.operators.joins import join_checked
from genoframe.tables import ensure_checkpoint_dir

# Lengths whose prefixes are hashed, in characters.
_GRID = [64 << k for k in range(25)]
_BLANKS_CUT, _BREAKS = " \t\r\n\f", ("\n", "\r")
#: How a longer text goes on after a prefix of it: blanks only, after a line's end, within it.
BLANKS, LINE_END, MID_LINE = 0, 1, 2

_LITERALS = r'''"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)|'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)'''
_C_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_LEXERS = {
    "c-like": re.compile(rf"(?s){_C_COMMENTS}|{_LITERALS}|`(?:\\.|[^`\\])*(?:`|\Z)|[(){{}}\[\]]"),
    "css": re.compile(rf"(?s)/\*.*?(?:\*/|\Z)|{_LITERALS}|[(){{}}\[\]]"),
    "sql": re.compile(r"""(?s)--[^\n]*|/\*.*?(?:\*/|\Z)|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[()]"""),
    "python": re.compile(rf"""(?s)\#[^\n]*|\"{{3}}(?:\\.|.)*?(?:\"{{3}}|\Z)|'{{3}}(?:\\.|.)*?(?:'{{3}}|\Z)|{_LITERALS}|[(){{}}\[\]]"""),
    "yaml": re.compile(rf"(?s)(?:^|(?<=\s))\#[^\n]*|(?<=[\s\[{{]){_LITERALS}"),
    "json": re.compile(r'(?s)"(?:\\.|[^"\\])*(?:"|\Z)|[{}\[\]]'),
}
_CLOSES = {")": "(", "]": "[", "}": "{"}

#: Marks of a language: words of which a text must hold one, pattern and weight.
_MARKS = {
    "python": [
        ("def ", r"^[ \t]*(?:async )?def \w+\(", 3),
        ("import |from ", r"^[ \t]*(?:import|from) [\w.]+", 2),
        ("class |elif |if |for |assert |raise |return ", r"^[ \t]*(?:class \w+.*:|elif |if .*:$|for .* in .*:$|assert |raise |return [^;{]*$)", 2),
        (" = (| = [| = {", r"^[A-Z_]\w* = [(\[{]", 5),
    ],
    "java": [("public|private|protected", r"^[ \t]*(?:public|private|protected)\b", 3), ("package ", r"^package [\w.]+;", 3), ("import ", r"^import [\w.]+;", 2)],
    "javascript": [
        ("const |let |var ", r"\b(?:const|let|var) \w+ ?=(?!=)", 3),
        ("function", r"\bfunction\b ?\w*\(", 3),
        ("=>", r"=>", 2),
        ("export|describe(|it(", r"^[ \t]*(?:export|describe\(|it\()", 2),
        ("this.", r"\bthis\.", 1),
        ("class ", r"^class \w+ \{", 3),
    ],
    "go": [("package ", r"^package \w+$", 4), ("func ", r"^func ", 4), (" struct", r"^type \w+ struct", 3), (":=", r":=", 2), ("var ", r"^var \w+ = ", 3)],
    "c": [
        ("#define|#include|#if|#endif", r"^#(?:define|include|ifdef|ifndef|endif)", 4),
        ("static|struct|typedef|unsigned|int|void|char", r"^(?:static|struct|typedef|unsigned|int|void|char)\b", 3),
        ("->", r"->", 2),
    ],
    "sql": [("CREATE|INSERT|SELECT|ALTER|UPDATE|DELETE|DROP|WITH", r"^(?:CREATE|INSERT|SELECT|ALTER|UPDATE|DELETE|DROP|WITH)\b", 4)],
    "css": [("{", r"^[.#@][\w-]+[^\n]*\{", 4), (": ", r"^[ \t]+[\w-]+: [^\n]*;$", 2)],
    "yaml": [(":", r"^[ \t]*[\w-]+:(?: |$)", 2), ("- ", r"^[ \t]*- ", 1)],
    # A heading has a blank line after it; lines of comments follow one another.
    "markdown": [("# ", r"^#{1,6} [^\n]*(?=\n[ \t]*\n|\s*\Z)", 3), ("* |- ", r"^[*-] ", 1)],
}
_MARKS = {kind: [(words.split("|"), re.compile(p, re.M), w) for words, p, w in marks] for kind, marks in _MARKS.items()}
_LEXER_OF = {"java": "c-like", "javascript": "c-like", "go": "c-like", "c": "c-like"}
_SENTENCE_END = re.compile(r"""[.!?:;)\]"'`*_>|]$""")
_NO_SENTENCE = re.compile(r"\s*(?:#{1,6}(?:\s|$)|[*+-]\s|\d+[.)]\s|```|~~~|\||>|=+$|-+$|\*+$)")
_BLOCK_START = re.compile(r"^(?![)\]}#\s])", re.M)
_RULE = re.compile(r"\W*$")
_FENCE = re.compile(r"^[ \t]*```[\w-]*[ \t]*$", re.M)
_OPEN_COMMENT = re.compile(r"^[ \t]*/\*(?!.*\*/)", re.M | re.S)
# A name after a dot may be a keyword in the files that this reads, though not in Python.
_KEYWORD_NAME = re.compile(r"\.(?:" + "|".join(keyword.kwlist) + r")\b")


def language_of(text: str) -> str:
    """The language whose marks are most, or ``text``."""
    if re.match(r'\s*(?:\{|\[)\s*(?:["{\[\]}]|$)', text):
        return "json"
    if _FENCE.search(text):
        return "markdown"
    plain = text
    score = {kind: sum(weight * len(p.findall(plain)) for words, p, weight in marks if any(w in plain for w in words)) for kind, marks in _MARKS.items()}
    best = max(score, key=score.__getitem__)
    return best if score[best] else "text"


def _scan(text: str, lexer: re.Pattern) -> tuple[bool, str | None, str]:
    """Whether a bracket is open at the end, whether the end is in a literal or comment,
    and the last token if the text ends with it. A closing bracket takes what stands
    above its partner along, and none if it has no partner."""
    stack: list[str] = []
    inside, last = None, ""
    for m in lexer.finditer(text):
        token = m[0]
        if token in "([{":
            stack.append(token)
        elif token in _CLOSES:
            if _CLOSES[token] in stack:
                while stack.pop() != _CLOSES[token]:
                    pass
        elif m.end() == len(text):
            last = token
            if token.startswith("/*"):
                inside = None if len(token) > 3 and token.endswith("*/") else "comment"
            elif token[:3] in ('"""', "'''"):
                inside = None if len(token) > 5 and token.endswith(token[:3]) else "literal"
            elif token[0] in "\"'`" and (len(token) < 2 or token[-1] != token[0]):
                inside = "literal"
    return bool(stack), inside, last


def _cut_comment(line: str) -> bool:
    """A comment of sentences whose last one has no end. Notes in lower case have none."""
    words = re.sub(r"^\W*", "", line)
    sentences = words[:1].isupper() or re.search(r"[.!?]\s+[A-Z]", words)
    return bool(sentences) and not re.search(r"""[.!?:;)\]"'`/]$""", words)


def _cut_statement(kind: str, line: str) -> bool:
    """The last line of code, outside of brackets and comments, lacks its end."""
    if kind in ("java", "javascript", "css", "sql"):
        return not re.search(r"[;})\]>:,]$", line)
    if kind == "c":
        return not (line.startswith("#") and re.match(r"#\s*(?:define\s+\w+\S*\s+\S|include\s*[<\"].*[>\"]|e\w+|if|pragma|undef)", line)) and not re.search(r"[;})]$", line)
    if kind == "go":
        return bool(re.fullmatch(r"(?:func|type|var|const|import|package)(?:\s+\w+)?", line)) and not line.startswith("package ")
    if kind == "yaml":
        return bool(re.fullmatch(r"[\w-]+|[\w-]+:|-", line)) and line not in ("---", "...")
    return False


def _cut_python(text: str) -> bool:
    starts = [m.start() for m in _BLOCK_START.finditer(text)]
    while starts:
        block = _KEYWORD_NAME.sub(".x", text[starts.pop() :])
        head = block.split("\n", 1)[0]
        if starts and re.match(r"(?:else|elif|except|finally)\b", head):
            continue
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(block)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            # Prose that was put into a file is no code, cut or not.
            return bool(re.match(r"(?:async\s+def|def|class|if|for|while|with|try|return|import|from|@|assert|raise|[A-Za-z_][\w.]*\s*(?:=|\())", head)) or len(head.split()) < 3
        # A bare name does nothing: it is the start of something else.
        node = tree
        while getattr(node, "body", None) and isinstance(node.body, list):
            node = (getattr(node, "finalbody", None) or getattr(node, "orelse", None) or node.body)[-1]
        return isinstance(node, ast.Expr) and isinstance(node.value, (ast.Name, ast.Attribute))
    return False


def cut_reason(text: str | None) -> str | None:
    """Why the text ends before its file did, or null."""
    if text is None:
        return None
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").rstrip()
    if not text:
        return None
    kind = language_of(text)
    body = re.sub(r"(?:\.\.\.|…)$", "", text).rstrip()
    line = body.rsplit("\n", 1)[-1].strip()
    if _RULE.fullmatch(line) and len(line) > 9:
        return None
    if kind in ("markdown", "text"):
        if "/*" in body and _OPEN_COMMENT.search(body):
            return "comment"
        if kind == "markdown" and len(re.findall(r"(?m)^\s*```", body)) % 2:
            return "block"
        raw = body.rsplit("\n", 1)[-1]
        if re.match(r"(?: {4}|\t)", raw) or _NO_SENTENCE.match(raw) or "\n" not in body and kind == "text":
            return None
        return None if _SENTENCE_END.search(line) else "sentence"
    opened, inside, last = _scan(body, _LEXERS[_LEXER_OF.get(kind, kind)])
    if inside:
        return inside
    if opened and kind != "yaml":
        return "block"
    if last.startswith(("//", "--", "#")) and not line.startswith(("#define", "#include")):
        return "comment" if _cut_comment(last) else None
    if last.startswith("/*"):
        return None
    if kind == "python":
        return "statement" if _cut_python(body) else None
    return "statement" if kind != "json" and _cut_statement(kind, line) else None


def _solid(text: Column) -> Column:
    """Characters of a text less its closing blanks."""
    return F.length(F.rtrim(text, F.lit(_BLANKS_CUT)))


def _heads(text: Column, n: Column) -> Column:
    """Hashes of the prefixes of all lengths of the grid that the text of ``n`` characters reaches."""
    grid = F.filter(F.array(*[F.lit(g) for g in _GRID]), lambda g: g <= n)
    return F.transform(grid, lambda g: F.xxhash64(F.call_function("left", text, g)))


def _kind(blank_rest: Column, at_line_end: Column) -> Column:
    return F.when(blank_rest, F.lit(BLANKS)).when(at_line_end, F.lit(LINE_END)).otherwise(F.lit(MID_LINE))


def _short_prefixes(ends: DataFrame) -> DataFrame:
    """(n, digest, kind) of texts below the grid that longer ones begin with. Their few
    lengths are looked up in the first characters of every text."""
    short = ends.filter(F.col("n") < _GRID[0]).select("n", F.col("first").alias("prefix")).distinct()
    lengths = sorted(r[0] for r in short.select("n").distinct().collect())  # below the grid's first
    if not lengths:
        return ends.select("n", "digest", F.lit(BLANKS).alias("kind")).limit(0)
    at = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n < F.col("n"))
    cut = ends.select("first", "solid", F.explode(at).alias("n"))
    prefix, after = F.call_function("left", F.col("first"), F.col("n")), F.call_function("substring", F.col("first"), F.col("n") + 1, F.lit(1))
    line_end = after.isin(*_BREAKS) | F.call_function("right", F.col("prefix"), F.lit(1)).isin(*_BREAKS)
    cut = cut.withColumn("prefix", prefix).select("n", "prefix", _kind(F.col("solid") <= F.col("n"), line_end).alias("kind"))
    return join_checked(cut, short, ["n", "prefix"], "left_semi").groupBy("n", F.md5(F.col("prefix").cast("binary")).alias("digest")).agg(F.max("kind").alias("kind"))


def _long_prefixes(texts: DataFrame, ends: DataFrame) -> DataFrame:
    """(n, digest, kind) of texts on the grid that longer ones begin with. Texts that share
    the head of the shorter one's last grid length are read again, and hash their own
    prefixes of exactly the lengths that occur there: no pairs."""
    steps = ends.filter(F.size("heads") > 0).select("digest", "n", "heads")
    last = steps.select(F.size("heads").alias("step"), F.element_at("heads", -1).alias("head"), "n")
    lengths = last.distinct()
    longest = steps.select("n", F.posexplode("heads").alias("_at", "head")).groupBy((F.col("_at") + 1).alias("step"), "head").agg(F.max("n").alias("_longest"))
    # Heads under which a text is longer than another one that ends there.
    open_ended = longest.join(lengths, ["step", "head"]).filter("_longest > n").select("step", "head", "n").withColumnRenamed("n", "cut_at").checkpoint()
    if open_ended.isEmpty():
        return ends.select("n", "digest", F.lit(BLANKS).alias("kind")).limit(0)
    spread = steps.select("digest", "n", F.posexplode("heads").alias("_at", "head")).select("digest", "n", (F.col("_at") + 1).alias("step"), "head")
    wanted = join_checked(spread, open_ended, ["step", "head"], "inner").filter("cut_at < n").groupBy("digest").agg(F.collect_set("cut_at").alias("cuts")).checkpoint()
    again = join_checked(texts.select("text", _digest(F.col("text")).alias("digest")), wanted, ["digest"], "inner")
    cut = again.select("text", _solid(F.col("text")).alias("solid"), F.explode("cuts").alias("n"))
    around = F.call_function("substring", F.col("text"), F.col("n"), F.lit(2))
    line_end = F.call_function("left", around, F.lit(1)).isin(*_BREAKS) | F.call_function("right", around, F.lit(1)).isin(*_BREAKS)
    prefix = F.call_function("left", F.col("text"), F.col("n"))
    return cut.select("n", _digest(prefix).alias("digest"), _kind(F.col("solid") <= F.col("n"), line_end).alias("kind")).groupBy("n", "digest").agg(F.max("kind").alias("kind"))


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _profile(docs: DataFrame, judge: bool) -> DataFrame:
    """One pass over the texts: what the self-join needs of each, and what its end says."""
    solid = docs.select("doc_id", "source", "text", _solid(F.col("text")).alias("solid"), F.length("text").alias("n")).filter("solid > 0")
    first = F.call_function("left", F.col("text"), F.lit(_GRID[0]))
    rows = solid.select("doc_id", "source", "solid", _digest(F.col("text")).alias("digest"), "n", first.alias("first"), _heads(F.col("text"), F.col("n")).alias("heads"), "text")
    ensure_checkpoint_dir(docs.sparkSession)
    if not judge:
        return rows.drop("text").checkpoint()
    schema = "doc_id bigint, source string, solid int, digest string, n int, first string, heads array<bigint>, reason string"
    return rows.mapInArrow(_judge, schema).checkpoint()


def _continued(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """(n, digest, kind) of each different text that is a strict prefix of a longer one."""
    ends = profile.select("n", "digest", "solid", "first", "heads").distinct()
    found = _short_prefixes(ends).unionByName(_long_prefixes(docs, ends))
    return ends.select("n", "digest").join(found, ["n", "digest"])


def prefix_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, kind) of each document whose text, of whatever length, is a strict
    prefix of a longer one elsewhere. ``kind`` says how the longest-reaching one of those goes
    on: 0 with blanks alone, 1 after a line's end, 2 within the line."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").filter("text is not null")
    profile = _profile(docs, judge=False)
    return join_checked(profile.select("doc_id", "source", "n", "digest"), _continued(docs, profile), ["n", "digest"], "inner").select("doc_id", "source", "kind")


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        reasons = pa.array([cut_reason(t) for t in batch.column("text").to_pylist()], pa.string())
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], reasons], names=[*kept, "reason"])


def truncated_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, reason, found_by) of each cut text of ``docs`` (doc_id, source, text):
    found by ``prefix`` where a longer copy goes on within the line, else by its ``end``."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").filter("text is not null")
    profile = _profile(docs, judge=True)
    going_on = _continued(docs, profile).filter(F.col("kind") == MID_LINE).select("n", "digest", F.lit(True).alias("_longer"))
    rows = join_checked(profile.select("doc_id", "source", "n", "digest", "reason"), going_on, ["n", "digest"])
    found = rows.filter("_longer or reason is not null")
    return found.select("doc_id", "source", F.when(F.col("_longer"), "continued").otherwise(F.col("reason")).alias("reason"), F.when(F.col("_longer"), "prefix").otherwise("end").alias("found_by")).distinct()

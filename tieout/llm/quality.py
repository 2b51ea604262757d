"""Line-first cleaning: rules judge every line, and a document that loses too much of its text goes.

Each line (between ``\\n``) that has a word is held against three rules, of which the first that it fails names it:

* ``boilerplate``: it holds a licence, copyright, cookie or subscription phrase.
* ``navigation``: a quarter of its words or more are separators such as ``|`` or ``›``, or all its words are
  names of menu entries.
* ``punctuation``: none of its words ends a sentence, or more than half of its words hold two marks of noise in
  a row (``!!``, ``***``, ``%%%``).

Lines that fail are taken out. A document stays unless it fails a document rule (``base_failed``: under 50
words, or over half of its words in three-word windows that occur twice or more) or more than 30 % of the code
points of its words were in lines that went.

A word is a run of characters other than ASCII white space. A NULL text has no words, as has an empty one or
one of white space only: all counts are 0, it fails, and its cleaned text is empty. Rows are judged each for
itself, also repeated ones and those without an id. Texts are read whole, block by block; a text longer
than a block is a block of its own. An empty table gives no rows. Only the id and the text are read, so other
columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tieout.llm.common import blocks

RULES = ("boilerplate", "navigation", "punctuation")
LEAST_WORDS = 50
#: In hundredths of the words, and of the code points of words.
MOST_REPEATED, MOST_LOST = 50, 30

SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SYMBOL = r"[#*$%&|<>]"
#: One match for each word that ends a sentence, holds noise, or is a separator.
ENDS = rf"[.!?…。！？]['\"”’»)\]]*(?:[{SPACE}]|$)"
NOISE = rf"[!?#*$%&<>=~^]{{2}}[^{SPACE}]*"
SEPARATOR = rf"(?:^|[{SPACE}])[|»›•·/>\\]+(?:[{SPACE}]|$)"
#: A line of nothing but these words is a menu.
ENTRY = "home|menu|about|contact|login|logout|search|help|faq|next|previous|back|top|share|print|sitemap|blog|news|shop|cart|us|more"
MENU = rf"(?i)^[{SPACE}]*(?:(?:{ENTRY})(?:[{SPACE}]+|$))+$"
PHRASES = (
    r"(?i)all rights reserved|licensed under|released under|copyright \(c\)|copyright ©|©|cookie policy|use of cookies|uses cookies|privacy policy"
    r"|terms of (?:use|service)|subscribe to our|sign up for our|powered by|enable javascript|share this (?:page|article)|lorem ipsum"
)

_WORD, _SYMBOL, _ENDS, _NOISE = re.compile(WORD), re.compile(SYMBOL), re.compile(ENDS), re.compile(NOISE)
#: As SEPARATOR, but neighbours share the space between them.
_SEPARATOR = re.compile(rf"(?<![^{SPACE}])[|»›•·/>\\]+(?![^{SPACE}])")
_MENU, _PHRASES = re.compile(MENU), re.compile(PHRASES)


def failed_rule(line: str, n_words: int) -> str | None:
    """The first rule that a line of ``n_words`` words, one at least, fails."""
    if _PHRASES.search(line):
        return "boilerplate"
    if 4 * len(_SEPARATOR.findall(line)) >= n_words or _MENU.search(line):
        return "navigation"
    if not _ENDS.search(line) or 2 * len(_NOISE.findall(line)) > n_words:
        return "punctuation"
    return None


def repeated(words: list[str], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first time included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    times = Counter(windows)
    if len(times) == len(windows):
        return 0
    marked = bytearray(len(words))
    for i, window in enumerate(windows):
        if times[window] > 1:
            marked[i : i + size] = b"\1" * size
    return marked.count(1)


def judge(text: str | None) -> dict[str, object]:
    """The counts of one text, its lines that failed, and what is left."""
    words, lost, kept, removed, seen, again = [], 0, [], [], set(), 0
    chars = 0
    for number, line in enumerate((text or "").split("\n")):
        found = _WORD.findall(line)
        if found:
            again += line in seen
            seen.add(line)
            words += found
            size = sum(map(len, found))
            chars += size
            rule = failed_rule(line, len(found))
            if rule:
                lost += size
                removed.append({"line": number, "rule": rule})
                continue
        kept.append(line)
    n, doubled = len(words), repeated(words)
    failed = n < LEAST_WORDS or 100 * doubled > MOST_REPEATED * n
    return {
        "clean_text": "\n".join(kept) if n else "",
        "n_words": n,
        "word_chars": chars,
        "n_symbols": len(_SYMBOL.findall(text or "")),
        "n_dup_lines": again,
        "n_repeat_words": doubled,
        "lost_chars": lost,
        "removed": removed,
        "base_failed": failed,
        "kept": not failed and 100 * lost <= MOST_LOST * chars,
    }


RESULT = (
    "clean_text string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lost_chars long, removed array<struct<line:int,rule:string>>, base_failed boolean, kept boolean"
)
ARROW = pa.schema(
    [("clean_text", pa.string()), *[(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")]]
    + [("removed", pa.list_(pa.struct([("line", pa.int32()), ("rule", pa.string())]))), ("base_failed", pa.bool_()), ("kept", pa.bool_())]
)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        rows = pa.RecordBatch.from_pylist([judge(t) for t in batch.column("text").to_pylist()], ARROW)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *rows.columns], ["id", *ARROW.names])


def clean(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: its id, the text without the lines that failed, the counts, the failed lines, and
    whether the document stays. The rows keep their partitions; nothing is shuffled."""
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType), *StructType.fromDDL(RESULT).fields])
    return rows.mapInArrow(_judged, schema).withColumnRenamed("id", id)


def removed_by(rule: str) -> Column:
    """How many lines a rule took out."""
    return F.size(F.filter("removed", lambda r: r["rule"] == rule)).cast("long")


def oracle() -> str:
    """The same judgement in DuckDB's SQL, over the table ``documents``."""
    q = {k: v.replace("'", "''") for k, v in {"word": WORD, "ends": ENDS, "noise": NOISE, "menu": MENU, "phrases": PHRASES, "symbol": SYMBOL}.items()}
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
lines as (
  select r, line, regexp_extract_all(line, '{q["word"]}') as w
  from (select r, unnest(string_split(text, chr(10))) as line from docs)
),
judged as (
  select r, line, w, list_sum(list_transform(w, lambda x: length(x))) as size,
    case when regexp_matches(line, '{q["phrases"]}') then 'boilerplate'
      when 4 * len(list_filter(w, lambda x: regexp_full_match(x, '[|»›•·/>\\\\]+'))) >= len(w) or regexp_matches(line, '{q["menu"]}') then 'navigation'
      when not regexp_matches(line, '{q["ends"]}') or 2 * len(list_filter(w, lambda x: regexp_matches(x, '{q["noise"]}'))) > len(w) then 'punctuation'
    end as rule
  from lines where len(w) > 0
),
by_line as (
  select r, sum(size) as word_chars, sum(case when rule is null then 0 else size end) as lost_chars,
    count(*) - count(distinct line) as n_dup_lines,
    count(*) filter (rule = 'boilerplate') as n_boilerplate, count(*) filter (rule = 'navigation') as n_navigation, count(*) filter (rule = 'punctuation') as n_punctuation
  from judged group by r
),
words as (select r, regexp_extract_all(text, '{q["word"]}') as w from docs),
windows as (
  select r, i, count(*) over (partition by r, g) as n
  from (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) as g from words where len(w) >= 3)
),
again as (select r, count(distinct i + d) as n_repeat_words from windows, (values (0), (1), (2)) as o(d) where n > 1 group by r),
counted as (
  select d.doc_id, len(w.w)::bigint as n_words, coalesce(b.word_chars, 0)::bigint as word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(b.n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(a.n_repeat_words, 0)::bigint as n_repeat_words, coalesce(b.lost_chars, 0)::bigint as lost_chars,
    coalesce(b.n_boilerplate, 0)::bigint as n_boilerplate, coalesce(b.n_navigation, 0)::bigint as n_navigation, coalesce(b.n_punctuation, 0)::bigint as n_punctuation
  from docs d join words w using (r) left join by_line b using (r) left join again a using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
  not (n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words) and 100 * lost_chars <= {MOST_LOST} * word_chars as kept,
  lost_chars, n_boilerplate, n_navigation, n_punctuation
from counted
"""

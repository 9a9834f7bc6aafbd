"""Per-document text statistics and fixed-threshold rules, each failure with its reason.

Everything is expressions over the text that run in the JVM: words, lengths, symbols, bullets,
line ends and common words of the document, and the share of its words that stand in running
sentences, from the same kinds of statistics of its lines and passages. The rules are a table
of (reason, statistic, lowest, highest):

* ``PUBLISHED``: thresholds published for large web corpora (50 to 100 000 words, mean word
  length 3 to 10, symbols to words at most 0.1, under 90 % bullet lines, under 30 % lines
  ending in an ellipsis, 80 % of words with a letter, at least two common words, 12 % of
  lines ending in punctuation).
* ``PROSE``, which decides: those of them that tell junk on any page (words, word length,
  symbols, bullets, ellipses, letters), and at least half of the words in running sentences.
  The other two are reported but don't decide: they reject plain sentences with hardly a
  function word, and pages of wrapped lines.

Lines are told by their statistics: bullets; table rows by bars, or by gaps with values or with
few common words; code by its symbols; encoded data by its digits; headings and menu entries
by their length and lack of a line end. Lines that go on are put together (a wrapped line is
about as long as the one before it), cut at sentence ends, and each passage has to have a
sentence end, a sentence's length, words of one readable script, some common words, names,
numbers or clauses, but not common words alone.

Defined results: null and empty texts have 0 words, shares of 0 and fail as ``words``; a
document that stands twice is judged twice; any language may mix with any other, as the
common words of all listed languages count; white space is what Unicode calls so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Listed common words, which become part of the plan; more are an error.
MAX_COMMON = 500_000

Rule = tuple[str, str, float | None, float | None]

PUBLISHED: list[Rule] = [
    ("words", "n_words", 50, 100_000), ("word_length", "mean_word_length", 3, 10), ("symbols", "symbol_ratio", None, 0.1), ("bullets", "bullet_share", None, 0.9),
    ("ellipses", "ellipsis_share", None, 0.3), ("letters", "alpha_share", 0.8, None), ("common_words", "n_common", 2, None), ("line_ends", "line_end_share", 0.12, None),
]
PROSE: list[Rule] = [
    ("words", "n_words", 50, None), ("word_length", "mean_word_length", 3, 10), ("symbols", "symbol_ratio", None, 0.1), ("bullets", "bullet_share", None, 0.9),
    ("ellipses", "ellipsis_share", None, 0.3), ("letters", "alpha_share", 0.8, None), ("sentences", "running_share", 0.5, None),
]

#: Fixed thresholds of lines and passages. A line below HEADING characters without an end is a heading or menu
#: entry; one below GOES_ON of the length of the line before it, without an end, doesn't go on from it.
HEADING, GOES_ON = 36, 0.6
#: Words of a passage: at least and at most (longer ones are lists that happen to end in a mark), and at least
#: without a capital at the start; common words at most, as natural sentences have others too.
PASSAGE_WORDS, LOWER_WORDS, ONLY_COMMON = (4, 120), 10, 0.72
#: Common words that a row of cells has at least if it is a sentence; words per comma, with 5 or more, in a list.
ROW_COMMON, COMMA_SHARE = 0.2, 0.3

_SPACES = "".join(map(chr, [0x0B, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_EDGES = "\"'.,;:!?…“”„«»‘’()[]¿¡-–—"
_W = r"[\p{L}\p{N}_]"
_CLOSE = r"[\"”»)']*"
_BULLET = r"\A\s*(?:[-*•·▪◦‣+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s"
_DASH = r"\A\s*[–—]\s"
# a word marked up: *word*, [word], ~word~, «word»
_MARKED = rf"[*\[~«_]+({_W}(?:{_W}|['’-])*[.,;:!?]?)[*\]~»_]+"
_BARS = r"\s[|;¦»·›]\s"
_GAPS = r"\t+| {2,}"
_VALUE = r"\A(?i:[-+]?\d[\d.,:]*\s?%?|—|-|n/a|yes|no)\z"
_CODE = r"[{}\[\]<>=_\\|~^$@#]|\d\d:\d\d:\d\d|https?:|\w\(|\);"
_STOP = rf"[.!?:…]{_CLOSE}\z"
_INNER = rf"{_W}[.!?]{_CLOSE}\s"
_START = r"\A[^\p{L}\p{N}]*[\p{Lu}0-9]"
_NAME = r"\A(?:\d|[^\p{L}\p{N}]*(?:[A-Z][a-z]|[А-ЯЁ][а-яё]))"
_BREAK = "\u001e"
_SENTENCE = rf"([^.!?:…{_BREAK}]+(?:[.!?:…]+{_CLOSE}(?:{_W}[^.!?:…{_BREAK}]*)?)*)"
_CYRILLIC, _FOREIGN = "[Ѐ-ӿ]", r"[^\x00-\x7fЀ-ӿ]"
# small first letters before capitals: a wrong code page, unless most letters are small anyway
_SWAPPED = r"(?:\A|[^\p{L}])[а-яё][А-ЯЁ]{2,}"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _known(words: Column, common: list[str]) -> Column:
    """How many of the words are common ones (a hash lookup per word)."""
    return F.size(F.filter(words, lambda w: F.lower(F.btrim(w, F.lit(_EDGES))).isin(common)))


def _once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """``df`` with a column that is worked out once, however often later expressions read it."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def _line(common: list[str]) -> Callable[[Column], Column]:
    """The statistics of a line (without quote marks in front)."""

    def told(raw: Column) -> Column:
        marked = raw.contains("*") | raw.contains("[") | raw.contains("~") | raw.contains("_") | raw.contains("«")
        return F.named_struct(F.lit("raw"), F.ltrim(raw), F.lit("text"), F.btrim(F.when(marked, F.regexp_replace(raw, _MARKED, "$1")).otherwise(raw), F.lit(" \t\r\f")))

    def stats(line: Column) -> Column:
        # plain searches first: an expression needs the text decoded, and most lines have nothing to find
        raw, text = F.left(line["raw"], F.lit(8)), line["text"]
        head, tail = F.left(text, F.lit(HEADING)), F.right(text, F.lit(8))
        words = _words(text)
        n, known = F.size(words), _known(words, common)
        cells = F.filter(F.split(text, _GAPS), lambda c: F.btrim(c) != "")
        value = lambda c: F.btrim(c).rlike(_VALUE)
        gaps, inner, grammar = text.contains("\t") | text.contains("  "), text.rlike(_INNER), known >= ROW_COMMON * n
        # a number between gaps may stand in a sentence, if the line goes over a sentence's end
        gap_row = F.when(~gaps, False).when(F.size(cells) == 2, value(F.element_at(cells, -1))).when(F.size(cells) >= 3, F.when(F.exists(cells, value), ~(grammar & inner)).otherwise(~grammar)).otherwise(False)
        code = _count(text, _CODE) > F.greatest(F.lit(1), F.floor(F.length(text) / 40))
        encoded = text.rlike(r"\d") & (n > 3) & (2 * F.size(F.filter(words, lambda w: w.rlike(r"\d"))) > n)
        small = head.rlike(r"\A\p{Ll}")
        return F.named_struct(
            F.lit("text"), text, F.lit("outside"), (text == "") | (_count(text, _BARS) >= 2) | gap_row | code | encoded, F.lit("bullet"), raw.rlike(_BULLET), F.lit("dash"), raw.rlike(_DASH), F.lit("ended"), tail.rlike(_STOP),
            F.lit("length"), F.length(text), F.lit("loose"), gaps & grammar, F.lit("small"), small, F.lit("capital"), head.rlike(_START), F.lit("inner"), small & inner, F.lit("spaces"), _count(head, " "),
        )

    told.stats = stats  # type: ignore[attr-defined]
    return told


def _joined(lines: str) -> Column:
    """The lines that may hold sentences as one text, with breaks where a stretch of them ends."""

    def kept(s: Column, i: Column) -> Column:
        before, after = F.get(lines, i - 1), F.get(lines, i + 1)
        open_ = F.coalesce(~before["outside"] & ~before["bullet"] & ~before["ended"], F.lit(False))
        # a dash in front of a line goes on a sentence that is open
        outside = s["outside"] | s["bullet"] | (s["dash"] & ~open_)
        goes_on = open_ & (s["ended"] | s["loose"] | before["loose"] | (s["length"] >= GOES_ON * before["length"]))
        # a short line without an end has to go on in the next one with a small letter
        continued = s["capital"] & (s["spaces"] >= 3) & F.coalesce(after["small"], F.lit(False))
        starts = s["ended"] | (s["loose"] & s["capital"]) | F.when(s["small"], (s["length"] >= HEADING) & s["inner"]).otherwise((s["length"] >= HEADING) | continued)
        text = F.when(outside, F.lit(_BREAK)).when(goes_on, s["text"]).when(starts, F.concat(F.lit(_BREAK), s["text"])).otherwise(F.lit(_BREAK))
        return F.concat(text, F.when(s["ended"], F.lit(_BREAK)).otherwise(F.lit("")))

    return F.array_join(F.transform(lines, kept), " ")


def _running(passages: Column) -> Column:
    """The passages that have a sentence's end, length and start."""

    def test(s: Column) -> Column:
        n = F.size(_words(s))
        return F.right(s, F.lit(8)).rlike(_STOP) & n.between(*PASSAGE_WORDS) & ((n >= LOWER_WORDS) | F.left(s, F.lit(16)).rlike(_START))

    return F.filter(passages, test)


def _passage(common: list[str]) -> Callable[[Column], Column]:
    """A passage with its words and how many of them are common."""
    return lambda s: F.named_struct(F.lit("text"), s, F.lit("words"), _words(s), F.lit("known"), _known(_words(s), common))


def _is_sentence(p: Column) -> Column:
    """Whether a passage has readable words, not common words alone, and some grammar, by its own statistics."""
    s, words, known = p["text"], p["words"], p["known"]
    n, commas, letters = F.size(words), _count(s, ","), _count(s, r"\p{L}")
    spoilt = F.size(F.filter(words, lambda w: (F.length(w) > 1) & (_count(F.btrim(w, F.lit(_EDGES)), _FOREIGN) > 0.6 * F.length(w))))
    plain = F.octet_length(s) == F.length(s)
    swapped = s.rlike(_SWAPPED) & (2 * _count(s, r"\p{Lu}") > letters)
    inner = F.substr(s, F.lit(1), F.length(s) - 1)
    clauses = inner.contains(",") | inner.contains(";") | F.exists(F.slice(words, F.lit(2), n), lambda w: w.rlike(_NAME))
    cyrillic = ~plain & (2 * _count(s, _CYRILLIC) > letters)
    listed = s.contains(",") & (commas >= 5) & (commas > COMMA_SHARE * n)
    return ~((n >= 5) & (known > ONLY_COMMON * n)) & (plain | (2 * spoilt <= n)) & F.when(cyrillic, (known > 0) & ~swapped).otherwise(~listed & ((known > 0) | clauses))


def common_list(common_words: DataFrame, word_col: str = "word") -> list[str]:
    """The listed words of all languages; a fixed list, checked against MAX_COMMON."""
    rows = common_words.select(F.lower(F.btrim(F.col(word_col)))).where(F.col(word_col).isNotNull()).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} common words")
    return sorted(r[0] for r in rows if r[0])


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def statistics(documents: DataFrame, common_words: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", running: bool = True) -> DataFrame:
    """(id, n_words, n_lines, mean_word_length, symbol_ratio, bullet_share, ellipsis_share, line_end_share, alpha_share, n_common, common_share, and with ``running`` running_share)."""
    common = common_list(common_words)
    text = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _SPACES, " " * len(_SPACES))
    rows = _once(documents.select(F.col(f"`{id_col}`").alias("__gw_id"), text.alias("__gw_text")), "__gw_raw", F.split("__gw_text", "\n"))
    t, filled = F.col("__gw_text"), F.filter("__gw_raw", lambda r: r.rlike(r"\S"))
    lines = lambda pattern: F.size(F.filter("__gw_raw", lambda r: r.rlike(pattern)))
    counts = {
        "words": _count(t, r"\S+"), "chars": _count(t, r"\S"), "symbols": _count(t, r"#|…|\.\.\."), "alpha": _count(t, r"\S*?\p{L}\S*"), "lines": F.size(filled),
        "bullets": lines(r"\A[ \t]*(?:[-*•·–—▪◦‣+]|[0-9]{1,3}[.)])\s"), "ellipses": lines(r"(?:…|\.\.\.)[ \t\r]*\z"), "line_ends": lines("[.!?…][\"”»)']*[ \\t\\r]*\\z"), "common": _known(_words(t), common),
    }
    rows = rows.withColumns({f"__gw_{n}": c.cast("bigint") for n, c in counts.items()})
    c = {n: F.col(f"__gw_{n}") for n in counts}
    out = {
        "n_words": c["words"], "n_lines": c["lines"], "mean_word_length": _share(c["chars"], c["words"]), "symbol_ratio": _share(c["symbols"], c["words"]), "bullet_share": _share(c["bullets"], c["lines"]),
        "ellipsis_share": _share(c["ellipses"], c["lines"]), "line_end_share": _share(c["line_ends"], c["lines"]), "alpha_share": _share(c["alpha"], c["words"]), "n_common": c["common"], "common_share": _share(c["common"], c["words"]),
    }
    if running:
        line = _line(common)
        rows = _once(rows, "__gw_told", F.transform("__gw_raw", lambda r: line(F.when(r.contains(">"), F.regexp_replace(r, r"\A\s*(?:>\s?)+", "")).otherwise(r))))
        rows = _once(rows, "__gw_lines_", F.transform("__gw_told", line.stats))
        passages = F.transform(F.regexp_extract_all(_joined("__gw_lines_"), F.lit(_SENTENCE), F.lit(1)), lambda s: F.btrim(s))
        rows = _once(rows, "__gw_passages", F.transform(_running(passages), _passage(common)))
        inside = F.aggregate(F.filter("__gw_passages", _is_sentence), F.lit(0), lambda a, p: a + F.size(p["words"]))
        rows = _once(rows, "__gw_inside", inside)
        out["running_share"] = F.least(_share(F.col("__gw_inside"), c["words"]), F.lit(1.0))
    return rows.select(F.col("__gw_id").alias(id_col), *(v.alias(n) for n, v in out.items()))


def reasons(rules: list[Rule]) -> Column:
    """The reasons of the rules that a row of statistics fails."""
    fails = []
    for reason, statistic, lowest, highest in rules:
        bad = F.lit(False)
        if lowest is not None:
            bad = bad | (F.col(statistic) < lowest)
        if highest is not None:
            bad = bad | (F.col(statistic) > highest)
        fails.append(F.when(bad, F.lit(reason)))
    return F.array_compact(F.array(*fails))


def judge(documents: DataFrame, common_words: DataFrame, *, rules: list[Rule] = PROSE, **columns) -> DataFrame:
    """The statistics with ``reasons`` (of ``rules``; empty for natural prose) and ``published_reasons``."""
    return statistics(documents, common_words, **columns).withColumns({"reasons": reasons(rules), "published_reasons": reasons(PUBLISHED)})

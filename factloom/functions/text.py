"""Text rules: normal forms for matching, quote coverage, grading texts, identifiers and links."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.batch import arrow_function

#: Coverage of a quote, its anchor, its least length.
COVERAGE = 0.90
ANCHOR = 30
QUOTE_CHARS = 15
QUOTE_DIGITS = 6
MONTHS = "january february march april may june july august september october november december".split()


def normal_form(text: str | None) -> str:
    """NFKC, case-folded, white space collapsed."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


class SuffixAutomaton:
    """All substrings of a text, built in one pass; ``longest_in`` reads another text in one pass."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]  # end: where a state's strings end first
        last = 0
        for at, letter in enumerate(text):
            now = self._state(self.length[last] + 1, at, {})
            p = last
            while p != -1 and letter not in self.next[p]:
                self.next[p][letter] = now
                p = self.link[p]
            if p == -1:
                self.link[now] = 0
            else:
                q = self.next[p][letter]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    copy = self._state(self.length[p] + 1, self.end[q], dict(self.next[q]))
                    self.link[copy] = self.link[q]
                    while p != -1 and self.next[p].get(letter) == q:
                        self.next[p][letter] = copy
                        p = self.link[p]
                    self.link[q] = self.link[now] = copy
            last = now

    def _state(self, length: int, end: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def longest_in(self, other: str) -> tuple[int, int, int]:
        """(start in ``other``, start in the text, size) of the longest common part: the first in ``other``, then in the text."""
        state = size = best = 0
        found = (0, 0)
        for at, letter in enumerate(other):
            while state and letter not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if letter in self.next[state]:
                state, size = self.next[state][letter], size + 1
            if size > best:
                best, found = size, (at - size + 1, self.end[state] - size + 1)
        return *found, best


def matching_blocks(source: str, quote: str) -> list[int]:
    """Sizes of the blocks that two texts share in order: the longest common part, then the same to its left and to its right."""
    sizes, parts = [], [(source, quote)]
    while parts:
        source, quote = parts.pop()
        in_source, in_quote, size = SuffixAutomaton(quote).longest_in(source) if source and quote else (0, 0, 0)
        if size:
            sizes.append(size)
            parts += [(source[:in_source], quote[:in_quote]), (source[in_source + size :], quote[in_quote + size :])]
    return sizes


def coverage(quote: str | None, source: str | None) -> tuple[bool, float, int]:
    """(contained exactly, share of the quote in matching blocks, longest block)."""
    q, s = normal_form(quote), normal_form(source)
    if not q:
        return False, 0.0, 0
    if q in s:
        return True, 1.0, len(q)
    sizes = matching_blocks(s, q)
    return False, sum(sizes) / len(q), max(sizes, default=0)


@arrow_function("string")
def _normal_form(texts: pa.Array) -> pa.Array:
    if texts.null_count == len(texts):
        return pa.nulls(len(texts), pa.string())
    return pa.array([None if t is None else normal_form(t) for t in texts.to_pylist()], pa.string())


def is_covered(quote: str | None, source: str | None) -> bool:
    """Contained exactly, or covered well with an anchor."""
    exact, share, longest = coverage(quote, source)
    return exact or (share >= COVERAGE and longest >= min(ANCHOR, len(normal_form(quote))))


@arrow_function("boolean")
def _covered(quotes: pa.Array, sources: pa.Array) -> pa.Array:
    if quotes.null_count == sources.null_count == len(quotes):
        return pa.nulls(len(quotes), pa.bool_())
    pairs = zip(quotes.to_pylist(), sources.to_pylist(), strict=True)
    return pa.array([None if q is None and s is None else is_covered(q, s) for q, s in pairs], pa.bool_())


def normalised_text(text: Column) -> Column:
    """``normal_form``: native for ASCII texts, where it is lower case and single blanks; Python only for the others."""
    simple, foreign = _is_simple(text), ~_is_simple(text) & ~is_ascii(text)
    return F.when(simple, F.trim(F.lower(text))).when(foreign, _normal_form(F.when(foreign, text))).otherwise(_ascii_form(text))  # Python sees nulls for the others: a condition alone does not spare it rows


def _is_simple(text: Column) -> Column:
    """Printable ASCII without two blanks in a row: lower case between its ends is its normal form."""
    return text.rlike(r"\A[ -~]*\z") & ~text.contains("  ")


def _ascii_form(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def quote_is_long_enough(quote: Column) -> Column:
    return (F.length(quote) >= QUOTE_CHARS) | (F.length(F.regexp_replace(quote, "[^0-9]", "")) >= QUOTE_DIGITS)


def quote_state(quote: Column, source: Column) -> Column:
    """What can be told of a quote without comparing letters: 'exact' (contained), 'none' (no anchor), or 'open'.

    A common part of ``ANCHOR`` characters holds one of the pieces that the quote is cut into at half that length, so a quote none
    of whose pieces stands in the source has none, and one shorter than an anchor must be contained. Texts that are not ASCII are open.
    """
    plain = F.coalesce(is_ascii(quote) & is_ascii(source), F.lit(False))
    forms = F.array(F.struct(plain.alias("plain"), _ascii_form(quote).alias("q"), _ascii_form(source).alias("s")))  # made once for all that is asked of them
    as_it_stands = is_ascii(source) & source.contains(quote) & quote.rlike(r"[^\s\x1c-\x1f]")  # most quotes, found without making forms
    return F.when(as_it_stands, "exact").otherwise(F.transform(forms, lambda p: F.when(~p["plain"], "open").when((p["q"] != "") & p["s"].contains(p["q"]), "exact").when(_may_be_close(p["q"], p["s"]), "open").otherwise("none"))[0])


def quote_matches(quote: Column, source: Column, state: Column) -> Column:
    """Long enough, and contained exactly or covered well with an anchor; ``state``: a column of the table that holds
    ``quote_state`` of the two, as Spark can't tell apart arguments of Python functions that nest lambdas. Only open pairs reach Python."""
    return quote_is_long_enough(normalised_text(quote)) & quote_stands(quote, source, state)


def quote_stands(quote: Column, source: Column, state: Column) -> Column:
    """``quote_matches`` of quotes that are known to be long enough."""
    close = _covered(*(F.when(state == "open", text) for text in (quote, source)))
    return F.when(state == "exact", True).when(state == "open", F.coalesce(close, F.lit(False))).otherwise(False)


def _may_be_close(q: Column, s: Column) -> Column:
    """Whether one of the pieces of half an anchor of a quote of an anchor or more stands in a source."""
    piece = ANCHOR // 2
    starts = F.sequence(F.lit(1), F.greatest(F.length(q) - piece + 1, F.lit(1)), F.lit(piece))
    return (F.length(q) >= ANCHOR) & F.exists(starts, lambda at: s.contains(q.substr(at, F.lit(piece))))


def folded(text: Column) -> Column:
    """Letters and digits only, for searching terms."""
    return F.trim(F.regexp_replace(normalised_text(text), "[^0-9a-z]+", " "))


def grading_text(text: Column) -> Column:
    """Lower-cased words between blanks with dates in ISO form: 'Month D, YYYY' and 'D Month YYYY' become YYYY-MM-DD."""
    out = F.lower(text)
    for i, month in enumerate(MONTHS, 1):
        for pattern, day, year in ((rf"\b{month}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", "$1", "$2"), (rf"\b(\d{{1,2}})\s+{month},?\s+(\d{{4}})\b", "$1", "$2")):
            out = F.regexp_replace(out, pattern, f"{year}-{i:02d}-0{day}")
    out = F.regexp_replace(out, r"(\d{4}-\d{2}-)0(\d{2})\b", "$1$2")
    out = F.regexp_replace(out, r"[^\w\s.%$-]", " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(" "))


def text_matches(expected: Column, answer: Column) -> Column:
    return grading_text(answer).contains(grading_text(expected))


def without_citations(text: Column) -> Column:
    """Text without [n] marks and bracketed citation headers."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\d+\]", " "), r"\[[^\]]*reportDate=[^\]]*\]", " ")


def doc_id(accession: Column, chunk_index: Column) -> Column:
    return F.concat_ws("_", accession, chunk_index.cast("string"))


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    """Archive address of a filing's document; blanks are percent-encoded."""
    name = F.replace(F.url_encode(document), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), name)


def excerpt(text: Column, limit: int = 100) -> Column:
    """At most ``limit`` characters that end at a word, null for a text with a table."""
    head = F.substring(text, 1, limit)
    cut = F.when(F.length(text) <= limit, text).otherwise(F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"\s+\S*$", "")).otherwise(head))
    return F.when(~text.contains("<TABLE>"), F.trim(cut))


def judge_verdict(output: Column) -> Column:
    """PASS or FAIL from the first line alone, else from the only verdict word in the output, else null."""
    first = F.upper(F.trim(F.split(output, "\n")[0]))
    said_pass, said_fail = output.rlike(r"(?i)\bpass\b"), output.rlike(r"(?i)\bfail\b")
    return F.when(first.isin("PASS", "FAIL"), first).when(said_pass & ~said_fail, "PASS").when(said_fail & ~said_pass, "FAIL")


def with_unit(value: Column, unit: Column) -> Column:
    """A value and its unit; the unit of a plain ratio is not shown."""
    return F.when(unit == "raw", value.cast("string")).otherwise(F.concat_ws(" ", value.cast("string"), unit))


def listed(items: Column, limit: int = 20) -> Column:
    """The first items and how many more there are."""
    more = F.size(items) - limit
    return F.concat(F.array_join(F.slice(items, 1, limit), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))


def fingerprint(*columns: Column) -> Column:
    """Twelve hex digits of the digest of some values."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 12)

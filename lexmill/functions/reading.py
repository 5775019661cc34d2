"""Facts in Arabic legal text, read from its words, numbers and marks.

A text is cut into tokens once; a reader looks at the tokens after a leading word and either takes what it knows or
gives up. Readers run on Arrow batches inside tasks, a text at a time, and hold nothing between texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import BIS, CURRENCIES, DEFINING_WORDS, MONTHS, ORDINALS, YEARS

_DIGITS = "0123456789٠١٢٣٤٥٦٧٨٩"
_TOKEN = re.compile("[0-9٠-٩]+|(?:[^\\W\\d_]|[ً-ْٰ])+|\\S")
#: Characters of a text in which its own number and year are looked for.
HEAD = 1000
#: What may close the number of an article at the start of a line.
_HEAD_MARKS = ":：-–"
#: A line that begins with an article's word, and the most tokens that a head has with what follows it.
_ARTICLE_LINE, _HEAD_TOKENS = re.compile(r"(?:\A|\n)[^\S\n]*((?:ال)?مادة)"), 16


class Words:
    """The tokens of a text, or some from a place on; places beyond the end read as empty."""

    def __init__(self, text: str, begin: int = 0, most: int | None = None):
        self.text, self.begin = text, begin
        self.tokens = _TOKEN.findall(text, begin) if most is None else [m[0] for m in islice(_TOKEN.finditer(text, begin), most)]

    @cached_property
    def starts(self) -> list[int]:
        """The tokens' places, which most texts are read without."""
        out, at = [], self.begin
        for token in self.tokens:  # only white space lies between tokens
            out.append(at := self.text.index(token, at))
            at += len(token)
        return out

    @cached_property
    def ends(self) -> list[int]:
        return [start + len(token) for start, token in zip(self.starts, self.tokens, strict=True)]

    def at(self, i: int) -> str:
        return self.tokens[i] if i < len(self.tokens) else ""

    def number(self, i: int) -> bool:
        return i < len(self.tokens) and self.tokens[i][0] in _DIGITS

    def skip(self, i: int, *phrases: str) -> int:
        """The place after the first of these phrases that stands at i; i if none does."""
        for phrase in phrases:
            words = phrase.split()
            if self.tokens[i : i + len(words)] == words:
                return i + len(words)
        return i

    def between(self, i: int, j: int) -> str:
        """The text of tokens i to j - 1."""
        return self.tokens[i] if j == i + 1 else self.text[self.starts[i] : self.ends[j - 1]]

    def after(self, *endings: str) -> Iterator[int]:
        """The places after words that end so, in order; a prefix such as "and" or "by" may stand before."""
        return (i + 1 for i, token in enumerate(self.tokens) if token.endswith(endings))

    def article(self, i: int, loose: bool = False) -> int | None:
        """The place after an article's number at i: digits, perhaps "bis", perhaps a letter in brackets.

        loose, as amendments write them: the letter may also follow a stroke, or stand in brackets after that.
        """
        if not self.number(i):
            return None
        i += 1
        if self.at(i).rstrip("ًٌٍَُِّْ").rstrip("اأإآى") == BIS:
            i += 1
        if loose and self.at(i) == "/" and self._letter(i + 1):
            i += 2
        if self.at(i) == "(" and self._letter(i + 1) and self.at(i + 2) == ")":
            i += 3
        return i

    def _letter(self, i: int) -> bool:
        return len(self.at(i)) == 1 and self.at(i).isalpha()

    def bracketed_article(self, i: int) -> tuple[str, int] | None:
        """An article's number that may stand in brackets, and the place after it."""
        first = self.skip(i, "(")
        end = self.article(first)
        return None if end is None else (self.between(first, end), self.skip(end, ")"))

    def amount(self, i: int) -> tuple[int, int] | None:
        """A number with its thousands parted by commas, and the place after it."""
        if not self.number(i):
            return None
        end = i + 1
        while self.at(end) == "," and self.number(end + 1) and self.starts[end + 1] == self.ends[end] == self.ends[end - 1] + 1:
            end += 2
        return int(self.between(i, end).replace(",", "")), end


#: Of these a text holds one if its reader finds anything; texts without any need not be read.
PENALTY_MARKS = ("سجن", "غرامة", "قتل", "إعدام", "الأشغال")
REFERENCE_MARKS = ("مادة", "المواد")


def _up_to(t: Words, i: int) -> int:
    return t.skip(i, "إلى", "حتى", "-")


def penalties(text: str) -> list[dict]:
    """Terms of imprisonment and fines with their range, then whether death or hard labour is named."""
    t, out = Words(text), []
    for i in t.after("سجن", "سجنا", "سجناً"):
        i = t.skip(t.skip(i, "مدة", "لمدة"), "من", "لا تقل عن")
        low = t.amount(i)
        middle = _up_to(t, low[1]) if low else 0
        high = t.amount(middle) if low and middle > low[1] else None
        unit = next((y for y in YEARS if t.at(high[1]).startswith(y)), None) if high else None
        if unit:
            out.append(("سجن", low[0], high[0], unit))
    for i in t.after("غرامة"):
        i = t.skip(i, "مالية")
        first = t.skip(i, "لا تقل عن", "تقل عن", "لا من", "من")
        low = t.amount(first) if first > i else None
        if low:
            end = low[1] + any(t.at(low[1]).startswith(c) for c in CURRENCIES)
            more = t.skip(end, "ولا تزيد على")
            more = more if more > end else _up_to(t, end)
            high = t.amount(more) if more > end else None
            out.append(("غرامة", low[0], high[0] if high else None, CURRENCIES[0]))
    if "قتل" in text or "إعدام" in text:
        out.append(("إعدام", None, None, None))
    if any(t.at(i).startswith("الشاقة") for i in t.after("الأشغال")):
        out.append(("أشغال_شاقة", None, None, None))
    return [dict(zip(("penalty_type", "min_value", "max_value", "unit"), p, strict=True)) for p in dict.fromkeys(out)]


def definitions(text: str) -> list[dict]:
    """What is meant by a term: after a defining word the term, perhaps in quotes, a colon or comma, the meaning.

    The meaning ends with a full stop, a blank line or the text, and may run over several lines.
    """
    t, out, done = Words(text), [], 0
    for i in t.after(*DEFINING_WORDS):
        begin = t.ends[i - 1]
        if begin < done or not text[begin : begin + 1].isspace():
            continue
        rest = text[begin:].lstrip()
        rest = next((rest[len(p) :] for p in ("ب", "من") if rest.startswith(p)), rest).lstrip()
        mark = next((k for k, c in enumerate(rest) if c in ":،"), -1)
        term = rest[:mark].strip()
        if term[:1] in ("'", '"'):
            term = term[1:]
        if term[-1:] in ("'", '"'):
            term = term[:-1]
        if mark < 0 or not term.strip() or "'" in term or '"' in term:
            continue
        meaning = rest[mark + 1 :]
        ends = [k for k in (meaning.find("."), meaning.find("\n\n")) if k >= 0]
        whole = meaning[: min(ends)] if ends else meaning
        done = len(text) - len(meaning) + len(whole)
        if whole.strip():
            out.append({"term": term.strip(), "definition_text": " ".join(whole.split())})
    return out


def references(text: str) -> list[str]:
    """Numbers of the articles that are mentioned, and of a second one joined to each."""
    t, out = Words(text), []
    for i in t.after("مادة", "المواد"):
        if found := t.bracketed_article(i):
            out.append(found[0])
            joined = t.skip(found[1], "و", "،", ",")
            if joined > found[1] and (second := t.bracketed_article(joined)):
                out.append(second[0])
    return list(dict.fromkeys(out))


def touched_articles(text: str, words: Words | None = None) -> list[str]:
    """Numbers of the articles that an amendment touches, first seen first."""
    t = words or Words(text)
    return list(dict.fromkeys(t.between(i, end) for i in t.after("مادة") if (end := t.article(i, loose=True))))


def asked_article(text: str) -> str | None:
    """The article that a question names; a letter counts only if it stands alone."""
    t = Words(text)
    for i in t.after("مادة"):
        i = t.skip(i, "(")
        if t.number(i):
            end = t.skip(i + 1, BIS)
            return t.between(i, end + 1 if end < len(t.tokens) and t._letter(end) else end)
    return None


def _cut_articles(text: str) -> list[tuple[str | None, str]]:
    """(number, body) of what stands before the first article, then of each article, with all white space.

    An article begins a line with its word and number; a colon, a dash or white space follows. Only the heads' tokens are
    read, as a text may have very many.
    """
    cuts = []
    for line in _ARTICLE_LINE.finditer(text):
        t = Words(text, line.start(1), _HEAD_TOKENS)
        found = t.bracketed_article(1) if t.at(0) in ("مادة", "المادة") else None
        if not found:
            continue
        number, end = found
        at = t.ends[end - 1]
        mark = t.at(end)[:1] in _HEAD_MARKS if t.at(end) else False
        if mark or text[at : at + 1].isspace():
            cuts.append((t.starts[0], number, t.ends[end] if mark else at))
    pieces = [(None, text[: cuts[0][0]] if cuts else text)]
    ends = [start for start, _, _ in cuts[1:]] + [len(text)]
    return pieces + [(number, text[body:end]) for (_, number, body), end in zip(cuts, ends, strict=False)]


def articles(text: str) -> list[dict]:
    """(number, body) of each article of a law; what stands before the first has no number. Blank bodies are left out."""
    return [{"pos": k, "number": number, "body": body.strip()} for k, (number, body) in enumerate(_cut_articles(text)) if body.strip()]


def articles_of_part(text: str) -> list[dict]:
    """articles of some lines of a law, last the number of heads in them. The first and the last piece, which may go on in
    the parts before and after, keep their white space, and are left out only if the part has others and they are the
    first and blank."""
    pieces = _cut_articles(text + "\n")
    last = len(pieces) - 1
    kept = [(k, number, body) for k, (number, body) in enumerate(pieces) if k == last or body.strip()]
    return [{"pos": k, "number": number, "body": body if k in (0, last) else body.strip(), "last": last} for k, number, body in kept]


def tables(text: str) -> list[dict]:
    """(number, body) of each numbered table with its head; a text without one is table 0."""
    t, cuts = Words(text), []
    for i in t.after("جدول"):
        first = t.skip(i + 1, "(") if t.at(i) == "رقم" else -1
        if first > 0 and t.number(first):
            cuts.append((t.starts[i - 1], t.at(first)))
    if not cuts:
        return [{"pos": 0, "number": "0", "body": text.strip()}] if text.strip() else []
    ends = [start for start, _ in cuts[1:]] + [len(text)]
    return [{"pos": k, "number": number, "body": text[start:end].strip()} for k, ((start, number), end) in enumerate(zip(cuts, ends, strict=True), 1)]


def law_and_years(text: str, words: Words | None = None) -> list[dict]:
    """The two numbers of each "law number ... of the year ...", in this order."""
    t, out = words or Words(text), []
    for i in t.after("قانون"):
        if t.at(i) == "رقم" and t.number(i + 1) and t.at(i + 2) == "لسنة" and t.number(i + 3):
            out.append({"a": int(t.at(i + 1)), "b": int(t.at(i + 3))})
    return out


def gregorian(text: str, words: Words | None = None) -> str | None:
    """The date after "corresponding to" as yyyy-mm-dd, perhaps with a weekday before it and without a day."""
    t = words or Words(text)
    for i in t.after("الموافق"):
        for at in (i, i + 1):  # with and without a weekday
            day = int(t.at(at)) if t.number(at) else None
            month = at + (day is not None)
            year = t.skip(month + 1, "سنة", "عام")
            if t.at(month) in MONTHS and t.number(year) and len(t.at(year)) >= 4:
                return f"{int(t.at(year)[:4]):04d}-{MONTHS.index(t.at(month)) + 1:02d}-{day or 1:02d}"
    return None


def ruling(text: str) -> dict:
    """Number and year of an appeal, the date of the session, the chamber, from the head of a ruling."""
    t, out = Words(text), dict.fromkeys(("case_number", "case_year", "ruling_date", "chamber"))
    for i in t.after("طعن"):
        end = i + 1
        while t.at(i) == "رقم" and t.number(end) and t.at(end + 1) in (",", "،") and t.number(end + 2):
            end += 2
        if t.at(i) == "رقم" and t.number(end) and t.at(end + 1) == "لسنة" and t.number(end + 2):
            out |= {"case_number": "".join(t.between(i + 1, end + 1).split()), "case_year": t.at(end + 2)}
            break
    for i in t.after("جلسة"):
        strokes = t.number(i) and t.at(i + 1) == t.at(i + 3) == "/" and t.number(i + 2) and t.number(i + 4)
        if strokes or (t.number(i) and t.at(i + 1) in MONTHS and t.number(i + 2)):
            out["ruling_date"] = t.between(i, i + (5 if strokes else 3))
            break
    for i in t.after("دائرة"):
        rest = re.split("[\n،,]", text[t.ends[i - 1] :], maxsplit=1)[0]
        if rest[:1].isspace() and rest.strip():
            out["chamber"] = rest.strip()
            break
    return out


def first_article(text: str) -> str | None:
    """What an amending law says in its first article."""
    _, found, rest = text.partition("المادة الأولى")
    body = rest.partition("المادة الثانية")[0].lstrip()
    return (body[1:] if body[:1] in (":", "：") and body else body).strip() or None if found else None


def amendment(text: str) -> dict:
    """What an amending law's text says, its words read once: numbers and years in its first HEAD characters, the articles it
    touches, its date, its first article."""
    t = Words(text)
    head = t if len(text) <= HEAD else Words(text[:HEAD])
    return {"pairs": law_and_years(head.text, head), "touched": touched_articles(text, t), "day": gregorian(text, t), "first": first_article(text)}


def outline(text: str) -> list[dict]:
    """Heads of a text with their places in characters: law, section, chapter, and each article with its body up to the
    next; sections and chapters are numbered or have one of the first four ordinals, articles one of ten."""
    t, out = Words(text), []
    for i, token in enumerate(t.tokens):
        start, found = t.starts[i], None
        if token.endswith("قانون") and t.at(i + 1) == "رقم" and t.number(i + 2) and t.at(i + 3) == "لسنة" and t.number(i + 4):
            found = ("law", t.between(i, i + 5))
        elif token.endswith(("باب", "فصل")) and (t.number(i + 1) or t.at(i + 1) in ORDINALS[:4]):
            found = ("section" if token.endswith("باب") else "chapter", t.between(i, i + 2))
        elif token.endswith("مادة"):
            j = i + 1
            while t.at(j) in ("(", ":", "-"):
                j += 1
            if t.number(j) or t.at(j) in ORDINALS:
                start = t.starts[i - 1] if i and t.at(i - 1) == "(" else start
                found = ("article", t.at(j) if t.number(j) else None)
        if found:
            out.append({"kind": found[0], "at": start, "value": found[1], "body": None})
    end = len(text)
    for head in reversed(out):
        if head["kind"] == "article":
            head["body"], end = text[head["at"] : end].strip(), head["at"]
    return out


def _column(read: Callable[[str], object], kind: str) -> Callable[[Column], Column]:
    """A column function of a reader; its type needs a session, so the function for tasks is made when it is called."""

    def column(text: Column) -> Column:
        @F.pandas_udf(f"array<{kind}>")
        def each(texts: pd.Series) -> pd.Series:
            return texts.map(lambda x: None if x is None else [read(x)])

        return F.get(each(text), F.lit(0))

    return column


#: Characters of texts whose pieces are Python objects at once, but for a longer text.
_AT_ONCE = 1 << 16


def _pieces(read: Callable[[str], list[dict]], **fields: pa.DataType) -> Callable[[Column], Column]:
    """A column function of a reader that cuts texts, which may be long: the pieces of a few go to Arrow before the next are read."""
    kind = pa.list_(pa.struct(list(fields.items())))

    def column(text: Column) -> Column:
        @F.arrow_udf(f"array<struct<{', '.join(f'{name}: {_NAMES[of]}' for name, of in fields.items())}>>")
        def each(texts: pa.Array) -> pa.Array:
            done, some, room = [pa.array([], kind)], [], _AT_ONCE
            for x in texts:
                one = x.as_py()
                some.append(None if one is None else read(one))
                room -= len(one or "")
                if room <= 0:
                    done.append(pa.array(some, kind))
                    some, room = [], _AT_ONCE
            return pa.concat_arrays([*done, pa.array(some, kind)])

        return each(text)

    return column


read_penalties = _column(penalties, "array<struct<penalty_type: string, min_value: bigint, max_value: bigint, unit: string>>")
read_definitions = _column(definitions, "array<struct<term: string, definition_text: string>>")
read_references = _column(references, "array<string>")
read_touched_articles = _column(touched_articles, "array<string>")
read_asked_article = _column(asked_article, "string")
_NAMES = {pa.int32(): "int", pa.string(): "string"}
_PIECE = {"pos": pa.int32(), "number": pa.string(), "body": pa.string()}
read_articles = _pieces(articles, **_PIECE)
read_articles_of_part = _pieces(articles_of_part, **_PIECE, last=pa.int32())
read_tables = _pieces(tables, **_PIECE)
read_law_and_years = _column(law_and_years, "array<struct<a: int, b: int>>")
read_gregorian = _column(gregorian, "string")
read_outline = _pieces(outline, kind=pa.string(), at=pa.int32(), value=pa.string(), body=pa.string())
read_amendment = _column(amendment, "struct<pairs: array<struct<a: int, b: int>>, touched: array<string>, day: string, first: string>")
read_first_article = _column(first_article, "string")
read_ruling = _column(ruling, "struct<case_number: string, case_year: string, ruling_date: string, chamber: string>")

"""Extraction of references and evidence from text, for what expressions cannot say: state machines run as Python UDFs over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADING = re.compile(r"^\s*(?:#+\s*)?(?:references|bibliography|works cited|参考文献)\s*:?\s*$", re.I)
OTHER_HEADING = re.compile(r"^\s*#+\s+\S")
ITEM = re.compile(r"^\s*(?:\[\d+\]|\d+[.)]|[-*+])\s+(.*)$")


def reference_lines(text: str) -> list[str]:
    """Items under a heading of references, with their continuation lines, up to the next heading."""
    out: list[str] = []
    inside, current = False, None
    for line in text.splitlines():
        if HEADING.match(line):
            inside, current = True, None
        elif inside and OTHER_HEADING.match(line):
            break
        elif inside:
            item = ITEM.match(line)
            if item:
                current = len(out)
                out.append(item[1].strip())
            elif not line.strip():
                current = None
            elif current is not None:
                out[current] += " " + line.strip()
            else:
                current = len(out)
                out.append(line.strip())
    return out


#: What makes a line a reference of its own.
IDENTIFIER = re.compile(r"10\.[0-9]{4,9}/[-._;()/:a-z0-9]+|\b(?:[0-9]{4}\.[0-9]{4,5}|[a-z][a-z-]*(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?\b", re.I)
YEAR = re.compile(r"\b(?:19|20)[0-9]{2}\b")
NAMES = re.compile(r"\b[A-Z][A-Za-z'`-]+,\s+[A-Z](?:\.|[A-Za-z'`-]+)|\b(?i:et\s+al)\.|\b[A-Z][A-Za-z'`-]+\s+and\s+[A-Z][A-Za-z'`-]+\b")
PLACES = re.compile(r"\b(?:journal|proceedings|conference|transactions|letters|review|arxiv|press|neurips|icml|acl|cvpr)\b", re.I)
PUBLISHED = re.compile(r"\b(?:journal|proceedings|conference|arxiv|press)\b", re.I)
SYNTAX = re.compile(r"^(?:\\[a-zA-Z]+|@[a-zA-Z]+\s*[{(]|```|</?[a-z])")


def cites(line: str) -> bool:
    return len(line) >= 20 and bool(IDENTIFIER.search(line) or YEAR.search(line) or PUBLISHED.search(line))


def stands_alone(line: str) -> bool:
    """A reference without a mark of a list: an identifier, or a year with names and a place of publication."""
    return len(line) >= 30 and bool(IDENTIFIER.search(line) or (YEAR.search(line) and NAMES.search(line) and PLACES.search(line)))


def loose_references(text: str) -> list[tuple[str, int, int]]:
    """References of a text without a heading for them, with first and last line: list items with their deeper or citing lines, and lines
    that stand alone. Items that cite nothing go."""
    found: list[list] = []
    depth: int | None = None
    for number, line in enumerate(text.splitlines(), start=1):
        body = line.strip()
        item = ITEM.match(body)
        indent = len(line) - len(line.lstrip())
        if not body or SYNTAX.match(body):
            depth = None
        elif item:
            found.append([[item[1]], number, number])
            depth = indent
        elif depth is not None and (indent > depth or (cites(body) and not stands_alone(body))):
            found[-1][0].append(body)
            found[-1][2] = number
        else:
            depth = None
            if stands_alone(body):
                found.append([[body], number, number])
    joined = ((" ".join(" ".join(parts).split()), first, last) for parts, first, last in found)
    return [x for x in joined if cites(x[0])]


class _Bib:
    def __init__(self, text: str):
        self.s, self.i, self.macros = text, 0, {}

    def skip(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def word(self) -> str:
        self.skip()
        m = re.compile(r"[^\s{}()=,#\"]+").match(self.s, self.i)
        if not m:
            return ""
        self.i = m.end()
        return m[0]

    def value(self) -> str:
        parts = []
        while True:
            self.skip()
            c = self.s[self.i : self.i + 1]
            if c in ('"', "{") and c:
                parts.append(self.quoted(c))
            else:
                w = self.word()
                parts.append(self.macros.get(w.lower(), w))
            self.skip()
            if self.s[self.i : self.i + 1] != "#":
                return re.sub(r"\s+", " ", "".join(parts)).strip()
            self.i += 1

    def quoted(self, c: str) -> str:
        self.i += 1
        start, depth = self.i, 0
        while self.i < len(self.s):
            x = self.s[self.i]
            if x == "\\":
                self.i += 1
            elif x == "{":
                depth += 1
            elif depth and x == "}":
                depth -= 1
            elif not depth and x == ("}" if c == "{" else '"'):
                self.i += 1
                return self.s[start : self.i - 1].replace("{", "").replace("}", "")
            self.i += 1
        return self.s[start:].replace("{", "").replace("}", "")

    def entries(self) -> Iterator[dict[str, str]]:
        while (at := self.s.find("@", self.i)) >= 0:
            self.i = at + 1
            kind = self.word().lower()
            self.skip()
            if self.s[self.i : self.i + 1] not in ("{", "(") or kind in ("comment", "preamble"):
                continue
            self.i += 1
            fields = {}
            if kind != "string":
                fields = {"entry_type": kind, "key": self.word()}
                self.skip()
                self.i += self.s[self.i : self.i + 1] == ","
            while self.i < len(self.s):
                name = self.word().lower()
                self.skip()
                if not name or self.s[self.i : self.i + 1] != "=":
                    break
                self.i += 1
                fields[name] = self.value()
                self.skip()
                if self.s[self.i : self.i + 1] != ",":
                    break
                self.i += 1
            if kind == "string":
                self.macros |= fields
            else:
                yield fields


def bibtex_entries(text: str) -> list[dict[str, str]]:
    """Entries with nested braces, quotes, ``#`` concatenation and ``@string`` macros."""
    return list(_Bib(text).entries())


def windows(text: str, words: int = 80, most: int = 4) -> list[str]:
    """Sentences packed into windows of at most ``words`` words; a longer one is cut into windows of its own. The whole text follows unless it is one of them; of all, the first ``most``, each once."""
    whole, out, held, n = " ".join(text.split()), [], [], 0

    def close():
        nonlocal held, n
        if held:
            out.append(" ".join(held))
        held, n = [], 0

    for sentence in re.split(r"(?<=[.!?])\s+", whole):
        size = len(sentence.split())
        if size > words:
            close()
            ws = sentence.split()
            out.extend(" ".join(ws[i : i + words]) for i in range(0, size, words))
        elif size:
            if n + size > words:
                close()
            held.append(sentence)
            n += size
    close()
    if whole and whole not in out:
        out.append(whole)
    return list({w.lower(): w for w in reversed(out[:most])}.values())[::-1]


#: What is read of a page, and what the name of a description holds.
HEADINGS, PARAGRAPHS, SKIPPED = ("h1", "h2", "h3"), ("p", "li", "blockquote"), ("script", "style", "svg", "noscript")
DESCRIPTIONS = ("description", "abstract", "summary", "citation_", "dc.description")


class _Page(HTMLParser):
    """(field, text) of descriptions, headings and paragraphs; an element that opens inside another begins anew."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip, self.field, self.text = [], 0, "", []

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "meta":
            a = {k: v for k, v in attrs if v}
            name, content = f"{a.get('name', '')} {a.get('property', '')}".lower(), " ".join(a.get("content", "").split())
            if content and any(d in name for d in DESCRIPTIONS):
                self.out.append(("meta", content))
        elif not self.skip and tag in (*HEADINGS, *PARAGRAPHS):
            self.field, self.text = "heading" if tag in HEADINGS else "paragraph", []

    def handle_endtag(self, tag):
        if tag in SKIPPED and self.skip:
            self.skip -= 1
        elif not self.skip and self.field and tag in (*HEADINGS, *PARAGRAPHS):
            text = " ".join("".join(self.text).split())
            if text:
                self.out.append((self.field, text))
            self.field, self.text = "", []

    def handle_data(self, data):
        if self.field and not self.skip:
            self.text.append(data)


def html_chunks(html: str, most: int = 6) -> list[tuple[str, str]]:
    """(field, text): the first window of two descriptions, of two headings (24 words) and of paragraphs, up to ``most``; each text once."""
    page = _Page()
    page.feed(html or "")
    page.close()
    of = lambda f: [t for g, t in page.out if g == f]
    found = [("meta", t, 80) for t in of("meta")[:2]] + [("heading", t, 24) for t in of("heading")[:2]]
    found += [("paragraph", t, 80) for t in of("paragraph")[: max(0, most - len(found))]]
    out: dict[str, tuple[str, str]] = {}
    for field, text, words in found:
        for w in windows(text, words, 1):
            out.setdefault(w.lower(), (field, w))
    return list(out.values())[:most]


def bibitems(text: str) -> list[dict[str, str]]:
    r"""``\bibitem`` entries: key and cleaned text, up to the next one or the end of the list; what is no citation goes."""
    out = []
    for part in re.split(r"\\bibitem(?=[\[{])", text)[1:]:
        m = re.match(r"(?:\[[^\]]*\])?\{([^}]*)\}", part)
        if m:
            body = part[m.end() :].split("\\end{thebibliography}")[0]
            body = re.sub(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", re.sub(r"%[^\n]*", "", body))
            body = " ".join(re.sub(r"\\[a-zA-Z]+", " ", re.sub(r"[{}]", "", body)).split())
            if len(body) >= 20 and re.search(r"\b(?:19|20)[0-9]{2}\b|10\.[0-9]{4,9}/|arxiv", body, re.IGNORECASE):
                out.append({"key": m[1].strip(), "raw_text": body})
    return out


def explode_with(df: DataFrame, key: str, text: str, fn, fields: str) -> DataFrame:
    """One row per item that ``fn(text)`` lists: key, ord and the fields."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text], strict=True):
                for i, x in enumerate(fn(t or "")):
                    rows.append((k, i, *((x,) if isinstance(x, str) else (x.get(n) for n in names) if isinstance(x, dict) else x)))
            yield pd.DataFrame(rows, columns=[key, "ord", *names])

    return df.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text)).mapInPandas(run, f"{key} long, ord int, {fields}")


def numbered(candidates: DataFrame, path: str, raw: str = "raw_text") -> DataFrame:
    """Candidates of each manuscript, each text once (its first place): source_index from 1 and source_locator."""
    from pyspark.sql.window import Window

    first = candidates.withColumn("__k", F.lower(F.col(raw))).withColumn("__r", F.row_number().over(Window.partitionBy(path, "__k").orderBy("ord"))).where("__r = 1")
    x = first.withColumn("source_index", F.row_number().over(Window.partitionBy(path).orderBy("ord"))).drop("__k", "__r")
    return x.withColumn("source_locator", F.concat(F.col(path).cast("string"), F.lit("#citation-"), F.col("source_index").cast("string")))

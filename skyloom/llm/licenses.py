"""Licence scans: Aho-Corasick over words and tags, shunting-yard over licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from .common import chosen, documents, mapped

# Phrases of notices, as words, and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE_PHRASES = {
    "mozilla public license": "mpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl", "eclipse public license": "epl", "eclipse distribution license": "bsd", "european union public licence": "eupl",
    "common development and distribution license": "cddl", "common public license": "cpl", "artistic license": "artistic", "academic free license": "afl",
    "open software license": "osl", "microsoft public license": "ms-pl", "python software foundation license": "python", "php license": "php", "openssl license": "openssl",
    "postgresql license": "postgresql", "zlib license": "zlib", "university of illinois ncsa open source license": "ncsa", "isc license": "isc",
    "bsd license": "bsd", "bsd licence": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "bsd 4 clause": "bsd", "2 clause bsd": "bsd", "3 clause bsd": "bsd", "new bsd": "bsd",
    "simplified bsd": "bsd", "boost software license": "bsl", "business source license": "busl", "server side public license": "sspl", "elastic license": "elastic",
    "the unlicense": "unlicense", "public domain": "public-domain", "wtf public license": "wtfpl", "sil open font license": "ofl", "open data commons open database license": "odbl",
    "open data commons attribution license": "odc-by", "community data license agreement permissive": "cdla-permissive", "community data license agreement sharing": "cdla-sharing",
    "creative commons zero": "cc0", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "all rights reserved": "proprietary", "proprietary and confidential": "proprietary",
    "mit licence": "mit", "apache licence": "apache", "expat license": "mit", "x11 license": "mit",
}
# Tags before an expression; after the first two any identifier is a licence, after the others prose may follow.
SURE_TAGS = ("spdx-license-identifier:", "license-expression:")
LOOSE_TAGS = ("\"license\":", "license:", "licence:")
# How free a licence family leaves its user (0 to 1).
FREEDOM = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit-0": 1.0, "wtfpl": 1.0,
    "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "zlib": 0.95, "x11": 0.95, "ncsa": 0.95, "postgresql": 0.95, "python": 0.95, "psf": 0.95, "curl": 0.95, "blueoak": 0.95,
    "apache": 0.9, "php": 0.9, "openssl": 0.85, "afl": 0.85, "cc-by": 0.85, "odc-by": 0.85, "cdla-permissive": 0.85, "ms-pl": 0.8, "artistic": 0.8, "ofl": 0.7,
    "mpl": 0.6, "epl": 0.6, "cpl": 0.6, "cddl": 0.6, "eupl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.5, "odbl": 0.5, "cdla-sharing": 0.5, "gfdl": 0.45, "osl": 0.4,
    "gpl": 0.35, "agpl": 0.25, "cc-by-nd": 0.2, "cc-by-nc": 0.15, "sspl": 0.15, "busl": 0.1, "elastic": 0.1, "cc-by-nc-sa": 0.1, "cc-by-nc-nd": 0.05, "proprietary": 0.0,
}
UNKNOWN = 0.3

_NOT_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TABLE = bytes.maketrans(_NOT_WORD + bytes(range(65, 91)), b" " * len(_NOT_WORD) + bytes(range(97, 123)))
_TOKEN = re.compile(r"[ \t]*([()/]|[A-Za-z0-9][A-Za-z0-9.+\-]*)")
_VERSION = re.compile(r"(-(v?\d[\w.]*|only|or-later))+$")
_LEAD = re.compile(r"[ \t\"']*")
_RANK = {"or": 1, "and": 2, "with": 3}


def words(text: str) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of text in lower-case A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def family(identifier: str) -> str:
    """The family of a licence identifier: its longest known leading part, else itself without a version; a + (or later) is
    part of the version."""
    parts = identifier.rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        if "-".join(parts[:n]) in FREEDOM:
            return "-".join(parts[:n])
    return _VERSION.sub("", "-".join(parts))


def parse(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: postfix of an and/or/with expression (with binds first, then and, then or), or None."""
    out, ops, operand = [], [], True
    for t in tokens:
        if t == "(" and operand:
            ops.append(t)
        elif t == ")" and not operand:
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                return None
            ops.pop()
        elif t in _RANK and not operand:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = True
        elif t not in _RANK and t not in "()" and operand:
            out.append(t)
            operand = False
        else:
            return None
    if operand or "(" in ops:
        return None
    return out + ops[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], float]:
    """Families that occur, and the freedom left: or offers the better side, and binds to the worse one,
    with adds an exception, which halves what the licence forbids."""
    stack = []
    for t in postfix:
        if t not in _RANK:
            stack.append(({family(t)}, FREEDOM.get(family(t), UNKNOWN)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append((a, 1 - (1 - x) / 2) if t == "with" else (a | b, max(x, y) if t == "or" else min(x, y)))
    return stack[0]


def longest_valid(text: str, at: int = 0, sure: bool = False) -> list[str] | None:
    """Postfix of the longest run of tokens from place `at` of a line that is an expression; read once, left to right. A slash
    between identifiers is an or. `sure`: the first identifier is a licence whatever its name, and so is one behind an operator in capitals."""
    tokens, operand, before, depth, end = [], True, "", 0, 0
    while m := _TOKEN.match(text, at):
        written, at = m[1], m.end()
        t = "or" if written == "/" else written if written in "()" else written.lower().rstrip(".-")
        # an expression goes on only over an operator: operand after operand is prose
        if operand and (t in _RANK or t == ")") or not operand and not (t in _RANK or t == ")") or t == ")" and not depth:
            break
        if operand and t != "(" and not sure and not (before == "with" or family(t) in FREEDOM or re.search(r"\d|^licenseref-", t)):
            break  # a word that names no licence
        depth += (t == "(") - (t == ")")
        operand = t in _RANK or t == "("
        if t in _RANK:
            sure = sure and written.isupper()
        before = t
        tokens.append(t)
        if not operand and not depth:
            end = len(tokens)  # what stands so far is whole
    return parse(tokens[:end]) if end else None


def _automata():
    phrases = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for phrase, label in {**MORE_PHRASES, **BASE_PHRASES}.items():
        phrases.add_word(f" {phrase} ", (phrase, label))
    tags = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for t in (*SURE_TAGS, *LOOSE_TAGS):
        tags.add_word(t, t in SURE_TAGS)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan(text: str, phrases, tags) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    ws = words(text)
    line = " " + b" ".join(ws).decode("utf-8", "replace") + " "
    base, labels, starts, freedom, at, gaps = set(), set(), [], [], 0, 0
    for end, (phrase, label) in phrases.iter(line):
        gaps, at = gaps + line.count(" ", at, end + 1), end + 1  # one gap before each word and one at the end
        labels.add(label)
        freedom.append(FREEDOM.get(label, UNKNOWN))
        if phrase in BASE_PHRASES:
            base.add(label)
            starts.append(gaps - 2 - phrase.count(" "))
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z alone: places stay
    for end, sure in tags.iter(low):
        if postfix := longest_valid(text, _LEAD.match(text, end + 1).end(), sure):
            found, free = evaluate(postfix)
            labels |= found
            freedom.append(free)
    return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(freedom, default=1.0))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: places of the base phrases, word by word. labels adds further notice phrases and the families
    in expressions after an identifier tag, to the end of its line; after SPDX-License-Identifier any identifier counts, after license: one
    that names a known family, has a digit or begins with LicenseRef-. score: freedom left by the strictest licence found, 1 where none is found. Null text counts
    as empty: no words, null first and last word, empty labels, score 1. Rows map one to one, so repeated
    rows, null ids and empty tables need no rule.
    """

    def run(batches):
        phrases, tags = _automata()
        for pdf in batches:
            out = pd.DataFrame([scan(t, phrases, tags) for t in pdf.text], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
            out[["first_word", "last_word"]] = out[["first_word", "last_word"]].astype("Int64")
            out.insert(0, "doc_id", pdf.doc_id.to_numpy())
            yield out

    kind = dict(docs.dtypes)[id_col]
    return mapped(chosen(docs, id_col, text_col), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def query(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))

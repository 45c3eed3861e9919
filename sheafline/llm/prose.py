"""The hand-written English prose of commit histories.

Whether a paragraph is English is told by its letters: three in a row of a word
have to be likelier by the English of the corpus than by how often each letter
occurs at all. That English is learned from all paragraphs in which frequent
English words are many and outweigh those of other languages; languages without
any list fail the test by themselves.
"""

from __future__ import annotations

import re

import numpy as np

# Where a commit starts, by layout: log, mailed patch, older numbered log.
_LOG = re.compile(r"commit [0-9a-f]{7,40}\b.*\Z")
_MAIL = re.compile(r"From [0-9a-f]{7,40} \w{3} \w{3} .*\Z")
_SVN_RULE = re.compile(r"-{60,}\s*\Z")
_SVN_HEAD = re.compile(r"r\d+ \| .*\| \d+ lines?\s*\Z")
_HEADER = re.compile(r"[A-Z][A-Za-z-]*:(\s|\Z)")
_DIFF = re.compile(r"(diff --git |diff -|Index: |--- (a/|/dev/null|\S+\t)|\+\+\+ |@@ |Binary files |GIT binary patch|index [0-9a-f]{6,}\.\.)")
_STAT = re.compile(r" \S.*\|\s+(\d+ ?[+-]*|Bin.*)\s*\Z| \d+ files? changed|\s(create|delete) mode |\s(rename|copy) ")
_TRAILER = re.compile(r"[A-Z][A-Za-z]*(-[A-Za-z]+)+: |(Fixes|Closes|Refs?|Link|Bug|Issue|See|Cc|Acked|Resolves|Tested|Reported|Reviewed|Merge)s?:? ?(#|https?://|[0-9a-f]{7,}\b)|[A-Z][A-Za-z]*: #?\d+\s*\Z|(Link|Cc|Bug|Issue|Refs?|See): |git-svn-id: |\(cherry picked from |\[\w+@?[^\]]*: ")
_WROTE = re.compile(r".{1,80} wrote:\Z")
_CONFLICTS = re.compile(r"#?\s*Conflicts:\s*\Z")
_WORD = re.compile(r"[A-Za-z]+(?:['’][A-Za-z]+)*")
_CODE = re.compile(r"`[^`]*`|\S*[_/\\]\S*|\S+\(\)\S*|\S*\d\S*|\S+@\S+|https?://\S+")
_LETTERS = re.compile(r"[^\W\d_]+")

# Frequent words that tell the languages apart.
ENGLISH = frozenset(
    "the a an and or of to in is was are were be been it its this that we i you he she they them not no now for on at by as "
    "with from but so if then than when which what there here has had have do does did can could will would should must may "
    "after before because since while until into only also each any all some more most other our your my us me let please one".split()
)
FOREIGN = frozenset(
    "der die das den dem des ein eine einen einem und oder nicht ist sind war wird werden wir ich sie es im am vom zum zur mit für auf "
    "aus bei nach vor bitte jetzt auch nur noch wenn dass le la les un une des du de et ou ne pas plus est sont était nous on il elle "
    "dans pour sur avec par que qui ce cette ces au aux reste el los las uno una y o no es son fue se lo del al en para con por como "
    "pero esta este ahora hay que ya sin".split()
) - ENGLISH


#: Share of frequent English words that makes a paragraph a sample of English.
SURE = 0.2


def messages(text: str) -> list[tuple[bool, list[str]]]:
    """The commit messages as (has_subject, lines), without headers, file
    summaries and diffs. ``has_subject`` tells that the first line is one."""
    lines = text.replace("\r\n", "\n").split("\n")
    out: list[tuple[bool, list[str]]] = []
    state, body, kind = "none", [], ""
    for k, line in enumerate(lines):
        start = ""
        if line.startswith("commit ") and _LOG.match(line):
            start = "log"
        elif line.startswith("From ") and _MAIL.match(line):
            start = "mail"
        elif line.startswith("-----") and _SVN_RULE.match(line) and k + 1 < len(lines) and _SVN_HEAD.match(lines[k + 1]):
            start = "svn"
        elif line.startswith("r") and state != "body" and _SVN_HEAD.match(line):
            start = "svn"
        if start:
            if start == "svn" and kind == "svn" and state == "head" and not body:
                continue  # the head line after its rule
            kind, state, body = start, "head", []
            out.append((kind != "mail", body))
            continue
        if state == "head":
            if not line.strip():
                state = "body"
            elif kind == "svn" and not _SVN_HEAD.match(line):
                state = "body"
                body.append(line)
            continue
        if state != "body":
            continue
        if kind == "log":
            if line.startswith("    "):
                body.append(line[4:])
            elif not line.strip():
                body.append("")
            elif line.startswith("\t"):
                body.append(line[1:])
            else:
                state = "rest"
        elif kind == "mail" and line.rstrip() == "---" or _DIFF.match(line) or _SVN_RULE.match(line) or line.rstrip("\n") == "-- ":
            state = "rest"
        elif _STAT.match(line):
            state = "rest"
        else:
            body.append(line)
    return out


def paragraphs(text: str, model: np.ndarray | None = None) -> list[str]:
    """English paragraphs of the messages without subject lines, trailers,
    quoted lines and conflict lists; without ``model`` by frequent words alone."""
    out = []
    for has_subject, lines in messages(text):
        k = 0
        if has_subject:
            while k < len(lines) and not lines[k].strip():
                k += 1
            k += 1
        part: list[str] = []
        listing = False
        for line in [*lines[k:], ""]:
            s = line.strip()
            if not s:
                if part and _is_english(joined := " ".join(part)) and (model is None or likeness(joined, model) > 0):
                    out.append(joined)
                part, listing = [], False
                continue
            if _CONFLICTS.match(s):
                listing = True
                continue
            if listing and (s.startswith("#") or line[:1] in " \t"):
                continue
            if s[0] in ">|" or s.startswith("#\t") or s == "---" or _TRAILER.match(s) or _WROTE.match(s):
                continue
            part.append(s)
    return out


def _is_english(paragraph: str, share: float = 0.0) -> bool:
    """By frequent words alone; with ``share`` so much of all words must be frequent English ones."""
    words = [w.lower() for w in _LETTERS.findall(paragraph)]
    if not words:
        return False
    strange = sum(1 for w in words if not w.isascii())
    english = sum(1 for w in words if w in ENGLISH)
    foreign = sum(1 for w in words if w in FOREIGN)
    return strange * 4 <= len(words) and foreign <= english and english >= share * len(words)


def surely_english(paragraph: str) -> bool:
    """Enough frequent English words to learn the letters of English from."""
    return _is_english(paragraph, SURE)


#: Letters, word ends and all other letters; three in a row are one number.
_SIGNS = 28


def triples(paragraph: str) -> np.ndarray:
    """Every three signs in a row of the paragraph's words, with their ends."""
    text = "".join("`" + w for w in _LETTERS.findall(paragraph.lower())) + "`"
    a = np.frombuffer(text.encode("ascii", "replace"), np.uint8).astype(np.int64) - 96
    a[(a < 0) | (a > 26)] = _SIGNS - 1
    return (a[:-2] * _SIGNS + a[1:-1]) * _SIGNS + a[2:]


def english_model(counts: np.ndarray) -> np.ndarray:
    """For every triple the logarithm of how much likelier its last sign is after
    the first two than anywhere, from counts of all triples in English text;
    seldom seen ones lean on the last two signs, and those on the last alone."""
    t = counts.reshape(_SIGNS, _SIGNS, _SIGNS).astype(float)
    alone = t.sum((0, 1)) + 1
    alone /= alone.sum()
    pair = t.sum(0)
    pair = (pair + 20 * alone) / (pair.sum(1, keepdims=True) + 20)
    return (np.log((t + 5 * pair[None]) / (t.sum(2, keepdims=True) + 5)) - np.log(alone)).ravel()


def likeness(paragraph: str, model: np.ndarray) -> float:
    """Mean log-likelihood ratio of the paragraph's triples; without letters 0."""
    at = triples(paragraph)
    return float(model[at].mean()) if len(at) else 0.0


def prose_words(text: str | None, model: np.ndarray | None = None) -> list[str]:
    """Lower-case words of the prose; code, numbers and addresses are no words."""
    if not text:
        return []
    return words_of(paragraphs(text, model))


def words_of(parts) -> list[str]:
    """Lower-case words of paragraphs."""
    words = []
    for p in parts:
        words += _WORD.findall(_CODE.sub(" ", p).lower())
    return words

"""Secrets by base patterns and by zstandard novelty.

Base matches (assignments, access ids, hexadecimal runs) are found by fixed patterns. Beyond them, a run of characters that stands in
sensitive context (after a word such as `key` or `auth` in its statement, or right beside a reported run) is measured: the bytes by which
it makes a zstandard frame longer that already holds the text around it, with a dictionary of all words of the text and of
names that code uses. What the text or its words can say costs matches of a few bytes and letters at the rate of the text's own; a random string
costs what its alphabet costs. A candidate that adds NOVEL or more of what random strings of its alphabet and length add there is
reported as kind `novel`. Nothing but these bytes decides: neither digits nor letters are asked for. Candidates are whole runs of any length, less what base matches cover. The body of a
private key block is sensitive on all its lines; it is measured as one string and reported run by run.

Defined cases: a null or empty text has no spans; a null doc_id stays null; repeated rows give repeated rows; an empty table
gives an empty result; further columns are ignored; a text of any length is searched whole, each candidate with the AROUND characters on both sides; a word that
stands in the text several times is one entry of the dictionary, and a secret that stands twice is reported at both places.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter
from itertools import islice

import zstandard
from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

#: Kinds in their order, base patterns, least lengths.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: What makes the rest of a statement sensitive, where a statement ends, what may part neighbours, and what a candidate looks like.
HINTS = ("key", "secret", "token", "passw", "pwd", "auth", "bearer", "credential", "private", "signature")
HINT = re.compile("|".join(HINTS).replace("key", "(?<!public[ _-])key", 1), re.A)
STATEMENT = re.compile(r"[.!?;](?=\s)|\n")
BESIDE = re.compile(r"[^A-Za-z0-9]{1,4}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LEAST = 16
#: Where a block of a private key begins and ends, and the runs between.
BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
END = re.compile(r"-----(?:BEGIN|END) ")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
APART = re.compile(r"""[^\s\\"',;]""")
DIGITS, LOWER_HEX, LOWER, UPPER_HEX, UPPER = string.digits, "abcdef", string.ascii_lowercase, "ABCDEF", string.ascii_uppercase
#: What goes into the dictionary: words outside of candidates, and names of several parts that the text uses more than once.
WORD = re.compile(r"[^\W_]{2,}")
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]{2,24}[0-9]{0,2}(?:[_.-][A-Za-z]{1,24}[0-9]{0,2}){1,6}(?![A-Za-z0-9])")
AROUND = 256
NOVEL = 0.85
#: Random strings that a candidate is held against.
DRAWS = 6
LEVEL = 19
#: Words that names in code are made of; they and the text's own words prime the dictionary.
NAMES = (
    "access account action active adapter address admin agent alert alias api application archive array async attribute audit authentication authority authorization backend backup balance base batch bearer binary block body "
    "branch bucket buffer build builder cache callback catalog category certificate channel check checksum client cloud cluster code collection column command comment common company component config configuration connection "
    "console container content context control controller cookie count counter country create credential current customer data database date default delete delivery department description design destination detail developer "
    "device directory document domain download driver element email employee encoding encryption endpoint engine entity entry environment error event example exception exchange execution export expression extension factory "
    "feature field file filter folder format framework frontend function gateway generator group handler hash header history host identifier image import index information input instance integration interface internal international "
    "inventory invoice iterator job key language ledger length level library license limit listener loader local location logger login manager mapping master member memory message metadata method migration mobile model module "
    "monitor name namespace network node notification number object operation option order organization output owner package page parameter parser password path payment period permission personal platform plugin policy pool port "
    "position price private processing processor product production profile project property protocol provider proxy public publisher query queue rate reader record reference region registry relation release remote report "
    "repository request resource response result role rollback root route router rule runner runtime sample schedule schema scope script search secret section secure security sequence serial server service session setting shared "
    "signature signing site size source stage standard state status storage store stream string structure subject subscription summary supplier support switch sync system table target task template tenant test text thread time "
    "timeout token tracker transaction transfer transport type update upload user utility validation value variable vendor version view warehouse webhook window worker workflow writer https://www.example.com/ localhost 127.0.0.1"
)


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in the order of the digest; low: the text in lower case, to pass over texts quickly."""
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def alphabet(token: str) -> str:
    """All characters of the classes that the token draws on (a-f alone before a-z); other characters as they are."""
    held, found = set(token), ""
    if held & set(DIGITS):
        found += DIGITS
    for few, many in ((LOWER_HEX, LOWER), (UPPER_HEX, UPPER)):
        own = held & set(many)
        if own:
            found += few if own <= set(few) else many
    return found + "".join(sorted(held - set(found)))


class Surroundings:
    """What a text's own words and the text around a place can say."""

    def __init__(self, text: str):
        words = dict.fromkeys(WORD.findall(CANDIDATE.sub(" ", text)))
        words |= {name: None for name, n in Counter(IDENTIFIER.findall(text)).items() if n > 1}
        names = f"{NAMES} {NAMES.title()} {DIGITS} ".encode()
        primed = zstandard.ZstdCompressionDict(names + " ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, around: bytes, token: str) -> int:
        """Marginal compressed bytes of the token after `around`."""
        return len(self.packer.compress(around + token.encode()))

    def novel(self, token: str, before: str, after: str) -> bool:
        """Does the token add about as many compressed bytes as random strings of its alphabet and length do?"""
        around = f"{after}\n{before} ".encode()
        none = len(self.packer.compress(around))
        letters, rng = alphabet(token), random.Random(token)
        drawn = sum(self.added(around, "".join(rng.choices(letters, k=len(token)))) - none for _ in range(DRAWS))
        return DRAWS * (self.added(around, token) - none) >= NOVEL * drawn


def sensitive_parts(low: str) -> list[tuple[int, int]]:
    """From the end of each hint to the end of its statement, in order and apart; where nothing but signs follows on the line, to that of the next line."""
    parts: list[tuple[int, int]] = []
    for m in HINT.finditer(low):
        if parts and m.end() <= parts[-1][1]:
            continue
        stop = STATEMENT.search(low, m.end())
        end = stop.start() if stop else len(low)
        if stop and stop[0] == "\n" and not WORD.search(low, m.end(), end):
            line = low.find("\n", stop.end())
            end = line if line >= 0 else len(low)
        parts.append((m.end(), end))
    return parts


def less(s: int, e: int, base: list[tuple[int, int, int]], at: int = 0) -> list[tuple[int, int]]:
    """What base matches, from the one at `at` on, leave of s-e."""
    left = []
    for b, _, c in islice(base, at, None):
        if b >= e:
            break
        if c > s:
            left.append((s, b))
            s = c
    return [(x, y) for x, y in [*left, (s, e)] if x < y]


def key_bodies(text: str) -> list[list[tuple[int, int]]]:
    """The runs of each private key's body: those of 16 characters and the short ones after the last of them.

    A block that never ends has a body as long as only white space, quotes and the like lie between its runs.
    """
    bodies = []
    for m in BEGIN.finditer(text):
        stop, last, runs = END.search(text, m.end()), m.end(), []
        for run in RUN.finditer(text, m.end(), stop.start() if stop else len(text)):
            if not stop and (run.end() - run.start() < LEAST or APART.search(text, last, run.start())):
                break
            last = run.end()
            runs.append(run.span())
        long = [i for i, (s, e) in enumerate(runs) if e - s >= LEAST]
        if long:
            bodies.append([r for i, r in enumerate(runs) if r[1] - r[0] >= LEAST or i > long[-1]])
    return bodies


def novel_spans(text: str, low: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not any(h in low for h in HINTS):
        return []
    found, at, within, known = [], 0, set(), None

    def stands_out(token: str, start: int, end: int) -> bool:
        nonlocal known
        own = text[start:end]  # said again it is no less a secret
        if known is None:
            known = Surroundings(text)
        return known.novel(token, text[max(0, start - AROUND) : start].replace(own, " "), text[end : end + AROUND].replace(own, " "))

    for runs in key_bodies(text) if "PRIVATE KEY" in text else []:
        body, first, last = "".join(text[s:e] for s, e in runs), runs[0][0], runs[-1][1]
        if stands_out(body, first, last):
            within.update(s for s, _ in runs)
            found += [(x, 3, y) for s, e in runs for x, y in less(s, e, base)]
    parts, part, beside = sensitive_parts(low), 0, -1
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(base) and base[at][2] <= s:
            at += 1
        while part < len(parts) and parts[part][1] <= s:
            part += 1
        if s in within:
            continue
        near = beside >= 0 and BESIDE.fullmatch(text, beside, s) is not None
        if not near and not (part < len(parts) and parts[part][0] <= s):
            continue
        left = less(s, e, base, at)
        rest = "".join(text[x:y] for x, y in left)
        if len(rest) >= LEAST and stands_out(rest, s, e):
            found += [(x, 3, y) for x, y in left]
            beside = e
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(text: str) -> tuple:
    low = text.lower()
    base = base_spans(text, low)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + novel_spans(text, low, base))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base matches), base_sha256, spans (base and novel)."""
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return map_texts(docs.select("doc_id", "text"), scan, schema)

"""URL filter: pattern rules are indexed by their rarest literal token; a URL's tokens fetch the rules that may fit, and only those run.

Every rule is a regular expression over `host` + path. The literal tokens that any URL it matches must hold whole are
derived from the expression itself. Tokens are the runs of ASCII letters and digits, A-Z lower-cased; expressions know
no other letters either (re.ASCII), so that the index loses no match. The rule's rarest token, by the number of URLs of
the table that hold it, is its one entry in the index; a rule without such tokens is run for every URL. So a URL runs
the few rules that its own tokens name, however many rules there are. The rules are a parameter, read by every task and
compiled when first fetched; URLs are never shuffled but for counting those tokens that rules hold.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _constants as C
from re import _parser as parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(rb"[a-z0-9]+")
ALNUM = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Rules are sent to every task: at most so many.
MOST_RULES = 1_000_000


def members(items: list) -> frozenset[int] | None:
    """The ASCII characters of a class of an expression; None if that isn't told."""
    out: set[int] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(value)
        elif op is C.RANGE:
            out.update(range(value[0], min(value[1], 127) + 1))
        elif op is C.CATEGORY and value in (C.CATEGORY_WORD, C.CATEGORY_DIGIT, C.CATEGORY_SPACE):
            out.update({C.CATEGORY_WORD: {*ALNUM, ord("_")}, C.CATEGORY_DIGIT: set(b"0123456789"), C.CATEGORY_SPACE: set(b" \t\n\r\f\v")}[value])
        elif op is not C.NEGATE:
            return None
    return frozenset(range(128)) - out if (C.NEGATE, None) in items else frozenset(out)


class Literals:
    """The tokens that every match of an expression holds whole; what can't be told yields none."""

    def __init__(self, pattern: str) -> None:
        self.tokens: set[str] = set()
        self.run, self.whole = "", False
        self.walk(parser.parse(pattern, re.ASCII), True)
        self.close(False)

    def close(self, bounded: bool) -> None:
        if self.run and self.whole and bounded:
            self.tokens.add(self.run)
        self.run = ""

    def walk(self, items, needed: bool) -> None:
        """`self.edge` says whether the sign before is surely none of a token."""
        for op, value in items:
            if op is C.LITERAL and value in ALNUM and needed:
                if not self.run:
                    self.whole = getattr(self, "edge", False)
                self.run += chr(value).lower()
                self.edge = False
            elif op in (C.LITERAL, C.NOT_LITERAL, C.IN, C.ANY):
                own = {value} if op is C.LITERAL else members(value) if op is C.IN else None
                self.edge = own is not None and not own & ALNUM
                self.close(self.edge)
            elif op is C.AT and value in (C.AT_BEGINNING, C.AT_BEGINNING_STRING, C.AT_END, C.AT_END_STRING, C.AT_BOUNDARY):
                # The end of a line that isn't the text's is no token's sign either.
                self.close(True)
                self.edge = True
            elif op is C.ASSERT_NOT and len(value[1]) == 1 and value[1][0][0] is C.IN and (members(value[1][0][1]) or frozenset()) >= ALNUM:
                if value[0] > 0:
                    self.close(True)
                elif not self.run:
                    self.edge = True
            elif op is C.SUBPATTERN:
                self.walk(value[3], needed)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] == value[1] == 1:
                self.walk(value[2], needed)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.BRANCH):
                self.close(False)
                before = getattr(self, "edge", False)
                ends = []
                for body in value[1] if op is C.BRANCH else [value[2]]:
                    self.edge = before
                    self.walk(body, False)
                    ends.append(self.edge)
                # A repeated body may also be left out.
                self.edge = all(ends) and (op is C.BRANCH or before or value[0] > 0)
            elif op not in (C.ASSERT, C.ASSERT_NOT):
                self.close(False)
                self.edge = False


@dataclass(frozen=True)
class Rule:
    name: str
    action: str  # allow or block
    pattern: str  # searched in host + path
    site: bool = False  # a (host, path) rule: these win over the others, the longest over shorter ones

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        return tuple(sorted(Literals(self.pattern).tokens))


def site(name: str, action: str) -> Rule:
    """A rule `host/path` for the host with its subdomains and the paths that start with it."""
    host, slash, path = name.partition("/")
    return Rule(name, action, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(slash + path)}", True)


def word(name: str, action: str, *tokens: str) -> Rule:
    """A rule for URLs with these tokens, one after the other with one sign between."""
    body = r"[^A-Za-z0-9]".join(map(re.escape, tokens))
    return Rule(name, action, rf"(?i)(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])")


#: The rules of the contract.
SITES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's own rules, for URLs that no site rule fits.
WORDS = (("spam-farm", ("spam", "farm")), ("casino", ("casino",)), ("poker", ("poker",)), ("porn", ("porn",)), ("xxx", ("xxx",)), ("viagra", ("viagra",)), ("torrent", ("torrent",)), ("warez", ("warez",)), ("free-download", ("free", "download")), ("click-here", ("click", "here")), ("ad-server", ("ad", "server")), ("link-farm", ("link", "farm")))
#: What is offered in spam, and how; each offer of each thing is a rule of its own.
OFFERS = "buy cheap order discount free best top online instant fast quick easy cheapest generic wholesale replica fake unlimited premium cracked leaked hot live real xl mega super vip no1 prescription".split()
THINGS = "pills meds cialis levitra tramadol xanax steroids loans payday forex crypto slots roulette blackjack betting jackpot lottery bingo escorts dating webcam nudes hentai keygen serials cracks proxies followers likes backlinks essays diplomas watches handbags ringtones streams iptv vpn sweepstakes giftcards".split()
RULES = (*(site(*x) for x in SITES), *(word(name, "block", *tokens) for name, tokens in WORDS), *(word(f"{a}-{b}", "block", a, b) for a in OFFERS for b in THINGS))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:end]


def held(host: str, path: str) -> set[str]:
    return {t.decode() for t in TOKEN.findall((host + path).encode("utf-8", "surrogatepass").lower())}


def token_frequencies(pages: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, int]:
    """How many URLs hold each token of the rules; one row for each such token comes to the driver, whatever the table's size."""
    wanted = {t for r in rules for t in r.tokens}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for u in b.column(0).to_pylist():
                n.update(held(*split_url(u)) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    counted = pages.select(F.col(f"`{url}`").cast("string")).mapInArrow(count, "token string, n long")
    return {r["token"]: r["n"] for r in counted.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def index(rules: tuple[Rule, ...], frequency: dict[str, int]) -> tuple[dict[str, list[Rule]], list[Rule]]:
    """Rules by their rarest token (ties: the first by name), and those without a token, which every URL runs."""
    by: dict[str, list[Rule]] = defaultdict(list)
    for r in rules:
        if r.tokens:
            by[min(r.tokens, key=lambda t: (frequency.get(t, 0), t))].append(r)
    return dict(by), [r for r in rules if not r.tokens]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, *, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule, verdict and matched (the names of all fitting rules, ascending) for each row of `pages`.

    The longest fitting site rule decides and is `rule`; otherwise rule is null and the verdict is block if a fitting
    word rule blocks, else `default`. A null URL or one without `://` has an empty host and path, which no rule fits.
    Repeated rows are judged each; only `key` and `url` are read; an empty table gives an empty result.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by, always = index(rules, token_frequencies(pages, rules, url))
    source = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").cast("string").alias("__url"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, re.Pattern] = {}

        def fits(rule: Rule, url: str) -> bool:
            if rule.pattern not in known:
                known[rule.pattern] = re.compile(rule.pattern, re.ASCII)
            return known[rule.pattern].search(url) is not None

        for b in batches:
            rows = []
            for u in b.column(1).to_pylist():
                host, path = split_url(u)
                fit = [r for t in held(host, path) for r in by.get(t, ()) if fits(r, host + path)] + [r for r in always if fits(r, host + path)]
                best = max((r for r in fit if r.site), key=lambda r: (len(r.name), r.name), default=None)
                other = "block" if any(r.action == "block" for r in fit) else default
                rows.append((host, path, best and best.name, best.action if best else other, sorted(r.name for r in fit)))
            host, path, rule, verdict, names = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(names, pa.list_(pa.string()))], names=[key, "host", "path", "rule", "verdict", "matched"])

    schema = T.StructType([source.schema[key], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")), T.StructField("matched", T.ArrayType(T.StringType()))])
    return source.mapInArrow(decide, schema)

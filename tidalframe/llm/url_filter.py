"""URL filtering with pattern rules indexed by their rarest literal token.

Every rule is a regular expression for the host and one for the path (both must be found) that carry literal tokens
(maximal runs of a-z and 0-9 that any match must hold whole). The two are judged apart, so no character of a URL can end a host. The index maps a rule's rarest token, the one that fewest
rules share, to the rule. A URL's own tokens fetch the candidate rules, and only those run their
expression; rules without a token always run.

Lists of rules, thousands of lines as browsers' blockers use them, come as a table of text lines (``read_list``): ``||`` opens a
host or one of its subdomains, ``^`` stands for a separator or the end, ``*`` for anything, a last ``|`` for the end of the
path, ``@@`` excepts; the rest of a line is literal, A-Z as a-z. Their tokens are the runs of a-z and 0-9 that such signs or other
characters close off on both sides. Empty lines and those that open with ``!`` or ``[`` are comments; lines that need more
than the host and the path (options after ``$``, ``#`` for parts of pages, a leading single ``|``, expressions between slashes) are
left out, and ``read_list`` says which. Queries of URLs are not looked at.

Host rules such as ``example.net/en/`` fit a host and all its subdomains where the path starts
with the rule's; the longest that fits decides. Otherwise an exception that fits allows, a fitting pattern or list rule
blocks, and the rest is allowed.

Edge cases: a null URL, an empty one or one without ``://`` has an empty host and path, fits no rule
and is allowed; rows that repeat are judged each; an empty table gives an empty result; other
columns are ignored. Rules must be few enough to ship to every worker: their number is checked.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tidalframe.llm.common import lean, prepare

#: Most rules that are shipped to the workers with the task.
MOST_RULES = 1_000_000

HOST_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The method's own rules, for URLs that no host rule decides: link farms, pills, betting, trackers.
PATTERN_RULES = (
    (r"(?:\A|[.-])cheap-(?:pills|meds)[.-]", ("cheap",)),
    (r"(?:\A|[.-])spam-farm[.-]", ("spam", "farm")),
    (r"(?:\A|[.-])casino[.-]", ("casino",)),
    (r"(?:\A|[.-])ads-track[.-]", ("ads", "track")),
    (r"(?:\A|[.-])adult-[a-z0-9]+\.", ("adult",)),
    (r"(?:\A|[.-])free-bets[.-]", ("free", "bets")),
)

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_TOKEN = re.compile(r"[a-z0-9]+")


class Rule(NamedTuple):
    """``name``: what is reported, null for a pattern rule; ``tokens``: literals every match holds."""

    name: str | None
    host: str
    path: str
    tokens: tuple[str, ...]
    verdict: str
    address: str | None = None  #: an expression for host and path as one, in lower case, in place of the two


def host_rule(name: str, verdict: str) -> Rule:
    host, slash, path = name.partition("/")
    path = slash + path
    whole = path if path.endswith("/") else path[: path.rfind("/") + 1]  # a prefix may end inside a token
    tokens = _TOKEN.findall(host.translate(_UPPER)) + _TOKEN.findall(whole.translate(_UPPER))
    return Rule(name, rf"(?:\A|\.){re.escape(host.translate(_UPPER))}\Z", rf"\A{re.escape(path)}", tuple(dict.fromkeys(tokens)), verdict)


def list_rule(line: str | None) -> Rule | None:
    """The rule of one line of a list; null for comments and for what host and path can't decide."""
    text = (line or "").strip().translate(_UPPER)
    verdict = "allow" if text.startswith("@@") else "block"
    text = text.removeprefix("@@")
    if not text or text[0] in "![" or "$" in text or "#" in text or (text[0] == "|" and text[:2] != "||") or (len(text) > 1 and text[0] == text[-1] == "/"):
        return None
    opened = text.startswith("||")
    closed = text.endswith("|") and len(text) > 2
    body = text[2 if opened else 0 : -1 if closed else None]
    if not body.strip("*^|"):
        return None
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%-]|\Z)"}
    address = (r"\A(?:[^/]*\.)?" if opened else "") + "".join(parts.get(c) or re.escape(c) for c in body) + (r"\Z" if closed else "")
    tokens = []
    for m in _TOKEN.finditer(body):
        left = opened if m.start() == 0 else body[m.start() - 1] != "*"
        right = closed if m.end() == len(body) else body[m.end()] != "*"
        if left and right:  # a neighbour that isn't a token's character ends the token in every match
            tokens.append(m[0])
    return Rule(None, "", "", tuple(dict.fromkeys(tokens)), verdict, address)


def read_list(lines: DataFrame, column: str = "value") -> tuple[list[Rule], DataFrame]:
    """The rules of a table of list lines, and the lines that make none; more than ``MOST_RULES`` lines are refused."""
    held = [r[0] for r in lines.select(lines[column].cast("string")).distinct().limit(MOST_RULES + 1).collect()]
    if len(held) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} lines; so many rules are not shipped to workers")
    made = [(x, list_rule(x)) for x in sorted(x for x in held if x is not None)]
    left = lines.sparkSession.createDataFrame([(x,) for x, rule in made if rule is None], f"{column} string")
    return [rule for _, rule in made if rule is not None], left


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z in lower case) and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = len(rest)
    for stop in "?#":
        if 0 <= (at := rest.find(stop)) < end:
            end = at
    rest = rest[:end]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class RuleIndex:
    """Rules by their rarest literal token."""

    def __init__(self, rules: Sequence[Rule]):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are shipped to workers")
        self.rules = list(rules)
        self.compiled: dict[int, tuple[re.Pattern, ...]] = {}
        self.run = 0  #: expressions run so far
        share = Counter(t for r in self.rules for t in set(r.tokens))
        self.by_token: dict[str, list[int]] = defaultdict(list)
        self.always: list[int] = []
        for i, r in enumerate(self.rules):
            if r.tokens:
                self.by_token[min(r.tokens, key=lambda t: (share[t], -len(t), t))].append(i)
            else:
                self.always.append(i)

    def _fits(self, i: int, host: str, path: str, address: str) -> bool:
        rule = self.rules[i]
        if i not in self.compiled:
            self.compiled[i] = tuple(re.compile(x, re.S) for x in ([rule.host, rule.path] if rule.address is None else [rule.address]))
        self.run += 1
        if rule.address is not None:
            return self.compiled[i][0].search(address) is not None
        of_host, of_path = self.compiled[i]
        return bool(of_host.search(host) and of_path.search(path))

    def matches(self, host: str, path: str) -> list[Rule]:
        address = (host + path).translate(_UPPER)
        wanted = {i for t in set(_TOKEN.findall(f"{host}\n{path}".translate(_UPPER))) for i in self.by_token.get(t, ())}
        return [self.rules[i] for i in [*self.always, *sorted(wanted)] if self._fits(i, host, path, address)]

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        found = self.matches(host, path)
        named = [r for r in found if r.name is not None]
        if named:
            best = max(named, key=lambda r: (len(r.name), r.name))
            return best.name, best.verdict
        verdicts = {r.verdict for r in found}
        return None, "block" if verdicts == {"block"} else "allow"


def filter_urls(pages: DataFrame, host_rules: Sequence[tuple[str, str]] = HOST_RULES, pattern_rules: Sequence[tuple[str, Sequence[str]]] = PATTERN_RULES, listed: Sequence[Rule] = ()) -> DataFrame:
    """Per row of ``pages``: page_id, url, host, path, rule, verdict; ``listed``: rules of ``read_list``."""
    prepare(pages.sparkSession)
    rules = [host_rule(*r) for r in host_rules] + [Rule(None, p, "", tuple(t), "block") for p, t in pattern_rules] + list(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules)
        for part in batches:
            split = [split_url(u) for u in part.column("url").to_pylist()]
            judged = [index.judge(*x) for x in split]
            columns = [[x[0] for x in split], [x[1] for x in split], [x[0] for x in judged], [x[1] for x in judged]]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *[pa.array(c, pa.string()) for c in columns]], names=["page_id", "url", "host", "path", "rule", "verdict"])

    given = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"))
    return given.mapInArrow(lean(run), "page_id long, url string, host string, path string, rule string, verdict string")

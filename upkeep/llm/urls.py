"""URL filters: a bit-parallel wildcard automaton over canonical URLs, under explicit host and path rules.

Glob rules (``**``: any run, ``*``: any run without a slash, ``?``: any character
but a slash) are packed into one multiword Shift-And automaton.  A bit stands for a
position of a rule, the first for its start; a step shifts all positions at once,
keeps those that the character allows, and lets a position stay that a run follows.
The URLs of a batch take their steps together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from upkeep.llm.common import small_batches

#: Words in a host, or as a path's folder, that mark unwanted sites.
BLOCKED_WORDS = (
    "casino", "poker", "roulette", "jackpot", "slot-machine", "sports-bet", "free-bets", "betting", "lottery-winner", "cheap-pills", "viagra", "cialis", "diet-pills", "no-prescription", "replica-watch", "payday-loan", "quick-loan",
    "adult-", "xxx-", "porn", "escort", "camgirl", "nude", "hookup", "spam-farm", "link-farm", "malware", "phishing", "keylogger", "ransomware", "warez", "keygen", "torrent", "cracked-", "free-robux", "click-fraud", "paywall-bypass",
)
#: Advertising and tracking hosts, files that hold no text, pages made by software.
BLOCKED_PLACES = (
    "url://ads.*/**", "url://*.ads.*/**", "url://adserver.*/**", "url://*.doubleclick.*/**", "url://track.*/**", "url://*.track.*/**", "url://pixel.*/**", "url://*/**.exe/", "url://*/**.dll/", "url://*/**.apk/", "url://*/**.iso/", "url://*/**.zip/",
    "url://*/**.rar/", "url://*/**.mp3/", "url://*/**.mp4/", "url://*/**.jpg/", "url://*/**.jpeg/", "url://*/**.png/", "url://*/**.gif/", )
BLOCKED_FOLDERS = (*(w.strip("-") for w in BLOCKED_WORDS), "wp-login.php", "wp-admin", "cgi-bin", "xmlrpc.php")
BLOCKED_GLOBS = (*(f"url://*{w}*/**" for w in BLOCKED_WORDS), *(f"url://*/{at}{w}/**" for w in BLOCKED_FOLDERS for at in ("", "**/")), *BLOCKED_PLACES)


def _positions(glob: str) -> list[tuple[str, str]]:
    """Characters of a glob, a start of no character first, each with the run (``*``, ``**`` or none) that follows."""
    out = [("", "")]
    for x in re.findall(r"\*+|[^*]", glob):
        if x[0] == "*":
            out[-1] = (out[-1][0], "**" if len(x) > 1 else "*")
        else:
            out.append((x, ""))
    return out


class GlobAutomaton:
    """All rules at once.  Rule ``k`` ends at bit ``final[k]``."""

    def __init__(self, globs: tuple[str, ...]):
        bits = [(c, run, at == 0) for g in globs for at, (c, run) in enumerate(_positions(g))]
        self.final = np.cumsum([len(_positions(g)) for g in globs], dtype=int) - 1
        self.words = max(1, -(-len(bits) // 64))
        self.known = np.array(sorted({ord(c) for c, _, _ in bits if c and c != "?"} | {ord("/")}), np.uint32)

        def pack(holds: Callable[[str, str, bool], bool]) -> np.ndarray:
            x = sum((1 << b for b, bit in enumerate(bits) if holds(*bit)), 0)
            return np.array([(x >> (64 * w)) & 0xFFFFFFFFFFFFFFFF for w in range(self.words)], np.uint64)

        self.start = pack(lambda c, run, first: first)
        self.masks = np.stack([pack(lambda c, run, first, k=k: c == chr(k) or c == "?" and k != ord("/")) for k in self.known] + [pack(lambda c, run, first: c == "?")])
        runs = pack(lambda c, run, first: run != "")
        self.stay = np.stack([pack(lambda c, run, first: run == "**") if k == ord("/") else runs for k in self.known] + [runs])

    def matches(self, texts: list[str]) -> np.ndarray:
        """texts x rules: whether the whole text fits the rule."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        size = np.array([len(texts[i]) for i in order], int)
        state = np.tile(self.start, (len(texts), 1))
        codes = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.searchsorted(self.known, codes)
        kind[self.known[np.minimum(kind, len(self.known) - 1)] != codes] = len(self.known)  # a character of no rule
        at = np.concatenate(([0], np.cumsum(size)))[:-1].astype(int)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step))  # those longer than step come first
            now, c = state[:live], kind[at[:live] + step]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = moved & ~self.start & self.masks[c] | now & self.stay[c]
        out = np.zeros((len(texts), len(self.final)), bool)
        out[order] = (state[:, self.final // 64] >> (self.final % 64).astype(np.uint64)) & np.uint64(1)
        return out


def read_globs(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Rules from a text file, one a line; blank lines and those that start with # are none.  A rule list is small: it goes to the driver."""
    lines = spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '#')")
    return tuple(r[0].strip() for r in lines.collect())


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url_host: Column, url_path: Column) -> Column:
    """Scheme, user, port, default page, query and fragment dropped; slashes collapsed; a trailing slash added."""
    bare = F.regexp_replace(F.regexp_replace(url_host, "^[^@]*@", ""), r"(:[0-9]*|\.)$", "")
    tail = F.regexp_replace(F.regexp_replace(F.concat(url_path, F.lit("/")), "/index\\.html?/$", "/"), "/+", "/")
    return F.when(url_host != "", F.concat(F.lit("url://"), bare, F.translate(tail, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).otherwise("")


def longest_rule(url_host: Column, url_path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule host/path that fits; rules: (verdict, host/path).  For a few hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        site, _, tail = text.partition("/")
        fits = ((url_host == site) | url_host.endswith("." + site)) & url_path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], globs: tuple[str, ...] = BLOCKED_GLOBS, url_col: str = "url") -> DataFrame:
    """pages' rows with host, path, rule, glob and verdict (allow or block) added; columns of these names give way, all others stay.

    The longest fitting rule decides; else the first glob that fits the canonical
    URL blocks.  A null url or one without :// has an empty host and path, fits no
    rule and is allowed.  Repeated rows stay.  A batch takes as many steps as its
    longest URL has characters.
    """
    small_batches(pages.sparkSession, 4096)
    made = ("host", "path", "rule", "glob", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    parts = F.struct(host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = GlobAutomaton(globs)
        for urls in batches:
            hit = automaton.matches([u or "" for u in urls.to_pylist()])
            some = hit.any(axis=1)
            yield pa.array([globs[k] if s else None for s, k in zip(some.tolist(), hit.argmax(axis=1).tolist(), strict=True)], pa.string())

    found = pages.select(*kept, parts.alias("path"))
    site, tail = F.col("path.host"), F.col("path.path")
    glob = F.arrow_udf(run, "string")(canonical(site, tail)) if globs else F.lit(None).cast("string")
    rule, verdict = longest_rule(site, tail, rules)
    found = found.select(*kept, "path", glob.alias("glob"), rule.alias("rule"), verdict.alias("verdict"))
    verdict = F.coalesce("verdict", F.when(F.col("glob").isNotNull(), "block").otherwise("allow"))
    return found.select(*kept, site.alias("host"), tail.alias("path"), "rule", "glob", verdict.alias("verdict"))

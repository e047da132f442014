"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton finds every strict and soft term of a URL in one
pass. A hit counts only between boundaries (no ASCII letter or digit on either
side). One strict term, or several distinct soft terms, reject the URL.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms that reject a URL alone.
STRICT = (
    # adult
    "porn", "porno", "pornhub", "xxx", "xvideos", "xnxx", "hentai", "camgirl", "camgirls", "escort", "escorts", "milf", "blowjob",
    "gangbang", "creampie", "bukkake", "fetish", "sexcam", "sexcams", "sexshop", "sextoy", "sextoys", "striptease", "upskirt", "bdsm",
    "livesex", "freesex", "redtube", "youporn", "swingers",
    # gambling
    "onlyslots", "onlinecasino", "slotmachine", "sportsbook", "bookmaker", "freespins",
    # unlawful copies and attacks
    "warez", "keygen", "serialkey", "nulled", "phishing", "malware", "ransomware", "botnet", "carding", "fullz",
    # drugs
    "buyviagra", "cheapviagra", "buycialis", "onlinepharmacy",
)
#: Terms that reject a URL when at least ``SOFT_HITS`` different ones occur.
SOFT = (
    # adult
    "adult", "adults", "sex", "sexy", "nude", "nudes", "nudity", "naked", "erotic", "erotica", "dating", "hookup", "hookups", "nsfw",
    "webcam", "webcams", "amateur", "mature", "teen", "lesbian", "lingerie", "uncensored", "strip", "kinky", "hardcore", "playboy",
    # gambling
    "casino", "casinos", "poker", "betting", "bets", "gambling", "slots", "roulette", "blackjack", "bingo", "jackpot", "lottery", "lotto", "odds",
    # drugs and money
    "viagra", "cialis", "levitra", "tramadol", "xanax", "steroids", "pharmacy", "pills", "payday", "loans", "forex", "replica", "cheap", "bonus",
    # unlawful copies
    "crack", "cracked", "torrent", "torrents", "serials", "hack", "hacks", "cheats", "piracy", "rapidshare",
)
SOFT_HITS = 2

SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"


class Rules:
    """Host and path rules; the longest that fits a URL wins.

    A rule is (verdict, "host/path"). It fits its host and all subdomains if
    the URL's path starts with the rule's. Lookup costs one probe a host label,
    whatever the number of rules.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        for fits in self.by_host.values():
            fits.sort(key=lambda r: (-len(r[0]), r[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, if any."""
        best, at = None, 0
        while True:
            for prefix, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(prefix):
                    if best is None or len(rule) > len(best[0]):
                        best = (rule, verdict)
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


class Vocabulary:
    """The automaton of strict and soft terms."""

    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, terms in ((0, soft), (1, strict)):
            for term in terms:
                self.automaton.add_word(term, (kind, term))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[int, int]:
        """Numbers of distinct strict and soft terms."""
        if not len(self.automaton):
            return 0, 0
        low = url.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        found = set()
        for end, hit in self.automaton.iter(low):
            start = end - len(hit[1]) + 1
            before, after = low[start - 1 : start] if start else "", low[end + 1 : end + 2]
            if not (_inner(before) or _inner(after)):
                found.add(hit)
        strict = sum(k for k, _ in found)
        return strict, len(found) - strict


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def judge_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str]],
    strict: Iterable[str] = STRICT,
    soft: Iterable[str] = SOFT,
    soft_hits: int = SOFT_HITS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """A verdict for every row: ``page_id, host, path, rule, verdict, strict_hits, soft_hits``.

    A null URL, or one without ``://``, has an empty host and path, fits no
    rule, and is judged by its terms (null: none). Rows keep their null or
    repeated ids; columns other than the two named are not read. Of rules that
    fit, the longest wins, host and path together; of equally long ones that of
    the longer host, then the first given. An empty table gives an empty result. Needs no shuffle.
    """
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("u")).select(
        "page_id",
        F.coalesce(F.col("u"), F.lit("")).alias("u"),
        F.coalesce(F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")), F.lit("")).alias("rest"),
    )
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = parts.select(
        "page_id",
        "u",
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), upper, upper.lower()).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    rules, strict, soft = list(rules), list(strict), list(soft)

    def run(batches):
        table, words = Rules(rules), Vocabulary(strict, soft)
        for b in batches:
            cols = b.to_pydict()
            out = {"rule": [], "verdict": [], "strict_hits": [], "soft_hits": []}
            for u, host, path in zip(cols["u"], cols["host"], cols["path"], strict=True):
                fit = table.find(host, path)
                hard, mild = words.hits(u)
                own = "block" if hard or mild >= soft_hits else "allow"
                out["rule"].append(fit[0] if fit else None)
                out["verdict"].append(fit[1] if fit else own)
                out["strict_hits"].append(hard)
                out["soft_hits"].append(mild)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("page_id"),
                    b.column("host"),
                    b.column("path"),
                    pa.array(out["rule"], pa.string()),
                    pa.array(out["verdict"], pa.string()),
                    pa.array(out["strict_hits"], pa.int32()),
                    pa.array(out["soft_hits"], pa.int32()),
                ],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"],
            )

    return parts.mapInArrow(run, SCHEMA)

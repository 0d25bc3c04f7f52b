"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are packed, one state a character, into the bits of a few 64-bit words. A
byte of a URL moves every pattern's states at once: shift by one, take in the start states,
keep those whose character fits the byte, and let states before a wildcard stay. Globs have
``*`` (any run of characters but ``/``), ``**`` (any run) and ``?`` (one byte); they
must fit the whole canonical URL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import column, map_arrow

#: Verdict, host and path of each base rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Globs on ``.host/path`` that block where no base rule fits.
GLOBS = (
    "**casino**",
    "**free-bets**",
    "**.spam-*",
    "**.spam-*/**",
    "**.ads-*",
    "**.ads-*/**",
    "**.ad?-track*",
    "**.adult-*",
    "**.adult-*/**",
    "**cheap-pills**",
    "**/*.exe",
    "**/porn*/**",
)
U = np.uint64


def canonical(url) -> tuple[F.Column, F.Column]:
    """(host, path) of a URL column; both empty for null or where ``://`` is missing."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


@dataclass
class Automaton:
    """Masks of a pattern set; ``chars[b]`` has the states that byte b may enter."""

    chars: np.ndarray
    start: np.ndarray
    stay: np.ndarray
    stay_inside: np.ndarray
    final: np.ndarray
    first: np.ndarray
    empty: np.ndarray

    @property
    def words(self) -> int:
        return self.chars.shape[1]


def compile_globs(globs: list[str]) -> Automaton:
    """State k of a pattern: its first k characters are read. Each pattern has a state 0,
    which the start of the URL sets and only a leading wildcard keeps."""
    states = []  # (byte or None for any, any run may follow, run without / may follow, is final)
    firsts = []
    for glob in globs:
        firsts.append(len(states))
        states.append([-1, False, False, False])
        data, k = glob.encode(), 0
        while k < len(data):
            if data[k : k + 2] == b"**":
                states[-1][1] = True
                k += 2
            elif data[k : k + 1] == b"*":
                states[-1][2] = True
                k += 1
            else:
                states.append([None if data[k : k + 1] == b"?" else data[k], False, False, False])
                k += 1
        states[-1][3] = True
    words = -(-len(states) // 64) or 1
    masks = {n: np.zeros(words, U) for n in ("start", "stay", "inside", "final")}
    chars = np.zeros((256, words), U)
    for k, (byte, stay, inside, final) in enumerate(states):
        word, bit = divmod(k, 64)
        for name, on in (("stay", stay), ("inside", inside), ("final", final), ("start", byte == -1)):
            if on:
                masks[name][word] |= U(1 << bit)
        if byte is None:
            chars[:, word] |= U(1 << bit)
        elif byte >= 0:
            chars[byte, word] |= U(1 << bit)
    return Automaton(chars, masks["start"], masks["stay"], masks["inside"], masks["final"], np.array(firsts), np.array([len(g) == 0 for g in globs]))


def simulate(auto: Automaton, texts: list[bytes]) -> np.ndarray:
    """(len(texts), patterns): which patterns fit each text, all patterns at once."""
    n = len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    state = np.broadcast_to(auto.start, (n, auto.words)).copy()
    either = auto.stay | auto.stay_inside
    live = n
    for at in range(int(sizes[0]) if n else 0):
        # longest first: those still running are the leading ones
        while live and sizes[live - 1] <= at:
            live -= 1
        byte = flat[begin[:live] + at]
        now = state[:live]
        moved = now << U(1)
        moved[:, 1:] |= now[:, :-1] >> U(63)
        moved &= auto.chars[byte]
        state[:live] = moved | (now & np.where((byte == 47)[:, None], auto.stay, either))
    out = np.zeros((n, len(auto.first)), bool)
    ends = np.append(auto.first[1:], None)
    hit = state & auto.final
    for p, (a, b) in enumerate(zip(auto.first, ends)):
        last = (int(b) if b is not None else _states(auto)) - 1
        word, bit = divmod(last, 64)
        out[order, p] = (hit[:, word] >> U(bit)) & U(1)
    return out


def _states(auto: Automaton) -> int:
    word = int(np.flatnonzero(auto.final)[-1])
    return word * 64 + int(auto.final[word]).bit_length()


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, globs=GLOBS) -> DataFrame:
    """``pages`` with host, path, rule and verdict, which replace columns of these names.

    The longest base rule that fits decides; where none does, a URL that fits a glob is
    blocked and any other allowed. A null URL, or one without ``://``, has an empty host and
    path, fits no base rule and is allowed. Each row is judged for itself, so rows that
    repeat are judged alike; an empty table gives an empty result.
    """
    # base rules as globs too: a host and its subdomains, then the path's prefix
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    auto = compile_globs([f"*.{host}{path}**" for _, host, path in ordered] + list(globs))
    names, verdicts = [host + path for _, host, path in ordered], [v for v, _, _ in ordered]
    added = ["host", "path", "rule", "verdict"]
    host, path = canonical(column(url_col))
    kept = [f for f in pages.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *[T.StructField(c, T.StringType()) for c in added]])
    ready = pages.select(*[column(f.name) for f in kept], host, path)

    def judge(batches):
        for batch in batches:
            asked = batch.columns[len(kept) :]
            hosts, paths = (c.to_pylist() for c in asked)
            fits = simulate(auto, [f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in zip(hosts, paths)])
            base = fits[:, : len(names)]
            which = np.where(base.any(1), base.argmax(1), -1)
            bad = fits[:, len(names) :].any(1)
            rule = [names[k] if k >= 0 else None for k in which]
            verdict = [verdicts[k] if k >= 0 else "block" if b else "allow" for k, b in zip(which, bad)]
            columns = batch.columns[: len(kept)] + [*asked, pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(ready, judge, schema)


def glob_regex(glob: str) -> str:
    """The regular expression that fits what the glob fits, for tests and SQL."""
    import re

    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**", k):
            out, k = out + r"[\s\S]*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        else:
            out, k = out + (r"[\s\S]" if glob[k] == "?" else re.escape(glob[k])), k + 1
    return f"^{out}$"

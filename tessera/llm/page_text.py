"""Main text of web pages by a host suffix array.

Pages are read into blocks of text by one walk over the markup. The pages of a host put their tokens into one stream, whose suffixes
are ranked to a depth of RUN tokens by prefix doubling. Runs of tokens that recur on several pages of different text are boilerplate; a block
which they cover goes, the runs of a page that are its own stay. Markup helps: navigation, forms, adverts and the like go at once,
and what stands inside <article> or <main> goes only if at least half of the pages repeat it, so passages that a few articles share stay. Names
of classes and ids never hide a page's only article: where all of them stand in parts with such names, they are read.

A large host is ranked in parts of even size. A run that is on so many of the host's pages is on as large a share of some part's
pages, so each part names the runs that are so frequent in it; only these are counted in all parts, and their sums over the host
judge every page. The texts of small hosts move once, those of large ones three times (nothing is stored in between: pages are read anew),
and no run that is rare everywhere moves at all.

Results in odd cases: null or empty html has the empty text; a null or malformed url is a host of its own (""); a null page_id is
kept; repeated rows have equal text and count once as evidence; unclosed and cut-off markup is read as far as it goes; a form around
the article doesn't hide it; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BYTE_CODE, discard, materialize, ngram_hash, prefix_hash, span_hash, word_spans

#: Tokens of a run that counts as repeated; pages that must have it, beside articles and inside (also these shares of the host's different pages).
RUN, PAGES, SHARE, PAGES_INSIDE, SHARE_INSIDE = 6, 3, 1 / 64, 5, 0.5
#: Bytes of pages of a host that share one suffix array; texts that a task remembers having sent already.
PART_BYTES, REMEMBERED = 16 << 20, 1 << 16

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer form head iframe input legend map menu nav noscript object option script select style svg template textarea title video".split())
CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}
# Word lists of our own: class and id names of parts beside the article, and ARIA roles of these.
HINTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination paywall popup privacy promo promoted promotion recommended related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription topbar toolbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())

RAW = {name: re.compile(rf"</{name}\s*+>", re.I) for name in ("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe")}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_PART = re.compile(r"[a-z0-9]+")
_MAIN = re.compile(r"<(?:article|main)\b|role=\"main\"", re.I)
#: Why a part is left out: not at all, as a form, by a name, otherwise. An article or main inside a form is read; one inside a part with such a name only
#: where the page has none elsewhere.
STAYS, AS_FORM, BY_NAME, OTHERWISE = 0, 1, 2, 3
#: Inside an article names count on containers only (ids on div only, those of readers' comments on all): what text itself is called says nothing about it.
CONTAINERS, REMARKS = frozenset("a div ol section span table ul".split()), frozenset("comment comments commentlist disqus respond".split())


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag ends whose attributes begin at `at`, -1 if nowhere. Quotes hold after "=" only; one without a second of its
    kind (then it is in `unclosed`) means nothing."""
    while stop := _STOP.search(page, at):
        if stop[0] == ">":
            return stop.end()
        at, before = stop.end(), stop.start() - 1
        while before > 0 and page[before].isspace():
            before -= 1
        if page[before] == "=" and stop[0] not in unclosed:
            close = page.find(stop[0], at)
            if close < 0:
                unclosed.add(stop[0])
            else:
                at = close + 1
    return -1


def markup(page: str):
    """(text, None, "") and ("", name, attributes) of a page in order, in one walk; names of end tags begin with "/". Comments, declarations and
    what scripts and the like hold are left out; a tag without an end ends the page."""
    at, unclosed = 0, set()
    while (start := page.find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), start):
            yield page[at:start], None, ""
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2 if mark == ">" else start + 4)
            if end < 0:
                return
            at = end + len(mark)
        elif name := _NAME.match(page, start + 1):
            yield page[at:start], None, ""
            end = _tag_end(page, name.end(), unclosed)
            if end < 0:
                return
            found, at = name[0].lower(), end
            if found in RAW:
                closing = RAW[found].search(page, end)
                at = closing.end() if closing else len(page)
            else:
                yield "", found, page[name.end() : end - 1]
        else:
            yield page[at : start + 1], None, ""
            at = start + 1
    yield page[at:], None, ""


def _left_out(name: str, attributes: str, inside: bool) -> int:
    if name in NEVER or (name == "header" and not inside):
        return AS_FORM if name == "form" else OTHERWISE
    if not attributes or name in ("html", "body", "main"):
        return STAYS
    for key, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key in ("class", "id"):
            words = set(_PART.findall(value))
            if name == "article":
                if words & {"comment", "comments"}:
                    return OTHERWISE
            elif inside and (name not in CONTAINERS or (key == "id" and name != "div" and not words & REMARKS)):
                continue
            elif words & HINTS or ("header" in words and not inside):
                return BY_NAME
        elif name == "article":
            continue
        elif (key == "role" and value in ROLES) or (key == "aria-hidden" and value == "true") or key == "hidden":
            return OTHERWISE
    return STAYS


def blocks_of(page: str, hints: bool = True, forms: bool = False, wrapped: bool = False) -> list[tuple[str, bool, bool]]:
    """(text, inside an article or main, only links) of the blocks in page order, without those that markup rules out. forms: those
    are read like any part; wrapped: an article or main is read whatever the parts around it are called."""
    out: list[tuple[str, bool, bool]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, left out, inside, link
    state = [False, True]  # whether the open block lies inside; whether it holds links only

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, state[0], state[1]))
            parts.clear()
        state[1] = True

    def add(text: str):
        if stack and stack[-1][1]:
            return
        if not parts:
            state[0] = bool(stack and stack[-1][2])
        parts.append(text)
        if not (stack and stack[-1][3]) and not text.isspace():
            state[1] = False

    open_tags: dict[str, int] = {}  # how many of each name are on the stack
    for text, name, attributes in markup(page):
        if name is None:
            if text:
                add(text)
            continue
        closes, name = name[0] == "/", name.lstrip("/")
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                add(" ")
            continue
        if name in BLOCKS:
            flush()
        if closes:
            if open_tags.get(name):
                while True:
                    gone = stack.pop()[0]
                    open_tags[gone] -= 1
                    if gone == name:
                        break
            continue
        while stack and name in CLOSES.get(stack[-1][0], ()):
            open_tags[stack.pop()[0]] -= 1
        above, inside, link = stack[-1][1:] if stack else (STAYS, False, False)
        is_main = name in ("article", "main") or 'role="main"' in attributes
        inside = inside or is_main
        own = (_left_out(name, attributes, inside) if hints else OTHERWISE if name in NEVER else STAYS)
        if name == "form":
            own = STAYS if forms else AS_FORM
        gone = own if is_main and above in ((AS_FORM, BY_NAME) if wrapped else (AS_FORM,)) else max(above, own)
        stack.append((name, gone, inside, link or name == "a"))
        open_tags[name] = open_tags.get(name, 0) + 1
    flush()
    return out


def run_ranks(tokens: np.ndarray, run: int) -> np.ndarray:
    """The rank of each suffix of the stream by its first `run` tokens; equal runs have equal ranks."""
    rank, depth = tokens.astype(np.int64), 1
    while depth < run:  # the order of suffixes by their first 2 * depth tokens, from that by depth
        step = min(depth, run - depth)
        pair = rank[: len(rank) - step] * np.int64(int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank


def holders_of(rank: np.ndarray, inside: np.ndarray, page: np.ndarray, content: np.ndarray) -> np.ndarray:
    """For each rank the number of different contents that hold its run. inside: places whose run lies in one page; content: by
    page, equal for equal pages, -1 where a page is no evidence."""
    own = content[page[inside]]
    inside, own = inside[own >= 0], own[own >= 0]
    holders = np.unique(rank[inside] * np.int64(len(content) + 1) + own) // np.int64(len(content) + 1)
    return np.bincount(holders, minlength=int(rank.max()) + 1)


class Stream:
    """The tokens of texts in a row, and the runs of RUN tokens that lie inside one text."""

    def __init__(self, texts: list[str]):
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        at = np.concatenate([[0], np.cumsum([len(d) for d in data], dtype=np.int64)]).astype(np.int64)
        buf = np.frombuffer(b"".join(data), np.uint8)
        starts, ends, self.page = word_spans((buf != 32) & (buf != 10), at)
        self.words = span_hash(prefix_hash(BYTE_CODE[buf]), starts, ends)
        n = max(len(self.words) - RUN + 1, 0)
        self.inside = np.flatnonzero(self.page[:n] == self.page[RUN - 1 :]) if n else np.zeros(0, np.int64)

    def counts(self, content: np.ndarray) -> np.ndarray:
        """For each inside run the number of contents that hold it."""
        if not len(self.inside):
            return np.zeros(0, np.int64)
        rank = run_ranks(np.unique(self.words, return_inverse=True)[1], RUN)
        return holders_of(rank, self.inside, self.page, content)[rank[self.inside]]

    def hashes(self) -> np.ndarray:
        """For each inside run a hash that is equal in every task."""
        return ngram_hash(self.words, RUN)[self.inside]

    def spread(self, counts: np.ndarray) -> np.ndarray:
        """For each token the greatest count of a run over it."""
        out = np.zeros(len(self.words), np.int64)
        for k in range(RUN):
            out[self.inside + k] = np.maximum(out[self.inside + k], counts)
        return out


def parse(page: str) -> tuple[str, str]:
    """The blocks' texts, one a line, and a digit for each: 1 inside an article or main, 2 only links."""
    in_form = bool(re.search(r"<form\b", page, re.I) and re.search(r"<p[\s>]", page, re.I))
    blocks = blocks_of(page)
    if not any(b[1] for b in blocks) and _MAIN.search(page):  # an article, but in a part whose name is a hint
        wrapped = blocks_of(page, wrapped=True)
        blocks = wrapped if any(b[1] for b in wrapped) else blocks
    blocks = blocks or (blocks_of(page, forms=True) if in_form else []) or blocks_of(page, hints=False)
    return "\n".join([b[0] for b in blocks]), "".join([str(b[1] + 2 * b[2]) for b in blocks])


def least_pages(n_contents: int) -> float:
    """Contents of a host that must hold a run for it to be boilerplate beside articles."""
    return max(PAGES, SHARE * n_contents)


def contents_of(texts: list[str]) -> np.ndarray:
    whole: dict[str, int] = {}
    return np.array([whole.setdefault(t, len(whole)) for t in texts], np.int64)


def judge(texts: list[str], flags: list[str], shared: np.ndarray, n_contents: int) -> list[str]:
    """The blocks that stay. shared: for each token the number of the host's contents that repeat a run over it."""
    many, some = max(PAGES_INSIDE, SHARE_INSIDE * n_contents), least_pages(n_contents)
    at, out = 0, []
    for page, marks in zip(texts, flags):
        kept = []
        scoped = any(m in "13" for m in marks)
        for text, mark in zip(page.split("\n"), marks):
            size = text.count(" ") + 1
            here = shared[at : at + size]
            at += size
            if mark in "13":
                keep = np.count_nonzero(here >= many) <= 0.9 * size
            elif scoped:
                keep = False
            else:
                keep = mark != "2" and np.count_nonzero(here >= some) <= 0.5 * size
            if keep:
                kept.append(text)
        out.append("\n".join(kept))
    return out


def main_texts(pages: list[str]) -> list[str]:
    """Main text of the pages of one host."""
    parsed = [parse(p) for p in pages]
    texts, flags = [t for t, _ in parsed], [m for _, m in parsed]
    stream, content = Stream(texts), contents_of(texts)
    return judge(texts, flags, stream.spread(stream.counts(content)), len(set(pages)))


def _parse(frames):
    """Pages -> blocks of text; of equal texts of a host the first that a task meets is evidence and goes to the part that the text names, the others are
    spread over the host's parts."""
    sent, again = set(), 0
    for pdf in frames:
        rows = []
        for host, page, parts in zip(pdf["host"], pdf["html"], pdf["parts"]):
            text, marks = parse(page)
            digest = hashlib.blake2b(f"{marks}\n{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            known = (host, digest) in sent
            if not known:
                if len(sent) >= REMEMBERED:
                    sent.clear()
                sent.add((host, digest))
            again += known
            rows.append((text, marks, int((again if known else int.from_bytes(digest[:8], "little")) % parts), not known))
        out = pd.DataFrame(rows, columns=["text", "marks", "part", "home"])
        yield pd.concat([pdf[["page_id", "url", "host", "page", "pages", "different"]].reset_index(drop=True), out], axis=1)


def _evidence(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Texts, and the content of each; -1 where it is no evidence here."""
    texts = pdf["text"].tolist()
    return texts, np.where(pdf["home"].to_numpy(bool), contents_of(texts), -1)


def _runs(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """The distinct runs of a part, how many of its contents hold each, and how many contents it has."""
    texts, content = _evidence(pdf)
    stream = Stream(texts)
    runs, first = np.unique(stream.hashes(), return_index=True)
    return runs, stream.counts(content)[first], len(np.unique(content[content >= 0]))


def _frequent(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs that are as frequent in this part as they must be in the whole host, whose parts have no fewer contents together than it has different pages
    and no more than it has pages."""
    runs, counts, contents = _runs(pdf)
    often = counts * int(pdf["pages"].iloc[0]) >= least_pages(int(pdf["different"].iloc[0])) * contents
    return pd.DataFrame({"host": pdf["host"].iloc[0], "run": runs[often].view(np.int64)})


def _count(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """How many contents of this part hold each run asked for."""
    if pages.empty or asked.empty:
        return pd.DataFrame({"host": [], "run": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}).astype({"host": str})
    runs, counts, _ = _runs(pages)
    known = np.isin(runs, asked["run"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"host": pages["host"].iloc[0], "run": runs[known].view(np.int64), "n": counts[known].astype(np.int64)})


def _judge_host(pages: pd.DataFrame) -> pd.DataFrame:
    texts, content = _evidence(pages)
    stream = Stream(texts)
    text = judge(texts, pages["marks"].tolist(), stream.spread(stream.counts(content)), pages["page"].nunique())
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": text})


def _judge_part(pages: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    if pages.empty:
        return pages[["page_id", "url", "text"]]
    found = found.sort_values("run")
    known, total = found["run"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    texts = pages["text"].tolist()
    stream = Stream(texts)
    own = stream.hashes().view(np.int64)
    at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
    counts = np.where(known[at] == own, total[at], 0) if len(known) else np.zeros(len(own), np.int64)
    text = judge(texts, pages["marks"].tolist(), stream.spread(counts), int(pages["different"].iloc[0]))
    return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": text})


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    page = F.xxhash64(html).alias("page")
    # of large hosts: parts, pages, different pages (by the hash of their bytes); a row for each 16 MB at most
    known = pages.select(host.alias("host"), page, F.octet_length(html).cast("long").alias("size")).groupBy("host", "page").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size"))
    hosts = known.groupBy("host").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("different"), F.ceil(F.sum("size") / PART_BYTES).cast("int").alias("parts"))
    large = materialize(hosts.where("parts > 1"), "large-hosts")
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), host.alias("host"), page)
    rows = rows.join(large, "host", "left").fillna({"parts": 1, "pages": 0, "different": 0})
    parsed = lambda some: rows.where(some).mapInPandas(_parse, f"page_id {kind}, url string, host string, page long, pages long, different long, text string, marks string, part int, home boolean")
    schema = f"page_id {kind}, url string, text string"
    out = parsed("parts = 1").groupBy("host").applyInPandas(_judge_host, schema)
    if not large.isEmpty():
        parts = parsed("parts > 1").groupBy("host", "part")
        spread = lambda runs: runs.join(large.select("host", "parts"), "host").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").groupBy("host", "part")
        asked = materialize(parts.applyInPandas(_frequent, "host string, run long").distinct(), "frequent-runs")
        counted = parts.cogroup(spread(asked)).applyInPandas(_count, "host string, run long, n long")
        least = F.greatest(F.lit(float(PAGES)), F.lit(SHARE) * F.col("different"))
        found = materialize(counted.groupBy("host", "run").agg(F.sum("n").alias("n")).join(large.select("host", "different"), "host").where(F.col("n") >= least).select("host", "run", "n"), "boilerplate")
        discard(asked)
        out = out.union(parts.cogroup(spread(found)).applyInPandas(_judge_part, schema))
    return out.withColumn("n_chars", F.length("text").cast("long"))

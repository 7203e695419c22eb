"""Operator 7, main text of web pages: structure first, then a suffix array over each host's pages.

A page is scanned once into blocks of text (cut at block-level tags) with their structural verdict: inside an article or
main element, inside an element that never holds main text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, comments...; by tag, role, class or id), or open. Open blocks are settled by the host: its pages' token streams
are laid end to end, and a suffix array finds strings of MIN_REPEAT tokens or more that occur on many distinct pages. Tokens of
open blocks that such strings cover are boilerplate and go; unique runs stay, unless they are scraps (each under MIN_REPEAT
tokens) of a block that is mostly covered. Repetition never removes a block inside an article: copies of one article on a host
are main text on each page, and so are titles that sidebars list (so the suffix array alone couldn't give right results).
On a page with an article or main element, open blocks outside it are dropped. The headings in an article's own header element
belong to the article, and so does a lead paragraph there (LEADS); bylines and share buttons don't. A form is out, its labels and
controls always; but an article or main element inside one counts as inside a marked element, and on a page without any other main
text a form that holds most of the text outside labels, with a sentence of MIN_REPEAT words or more, is the page's body (some
systems wrap whole pages in one form): it is open, or inside an article's element part of that. Only whole tokens of a class, id or role mark an
element, and only a hidden attribute or aria-hidden="true" hides one. An article or main element inside an element that just its
class, id or role marks counts where the page has no other.

Hosts without an open page need no more than structure. Another of up to GROUP_PAGES pages is one group in one task. As one host may hold any share of all pages, a larger host is never
gathered: the cluster counts the distinct pages of each of its strings (partial sums), and its open pages look theirs up. Both
ways decide by counts over the whole host.

Edge cases: null and empty html, and pages without text, give an empty text. A null or odd url makes a host of its own
text. Unclosed elements end with their parent. Repeated rows are pages like others, but don't count as distinct pages for
repetition. Columns other than the three are never read.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import arrays as A
from tributary.llm.shared import release, save, small_batches

#: Pages of a host that one task takes.
GROUP_PAGES = 256
#: Hosts that are broadcast; more of them are joined by a shuffle.
MAX_HOSTS = 1 << 18
#: Tokens of a repeated string; pages it must be on, and their share of the host; share of an open block beyond which scraps
#: between such strings go with them.
MIN_REPEAT = 6
MIN_PAGES = 3
PAGE_SHARE = 0.1
COVERED = 0.5

#: Elements of the HTML standard.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes iframe".split())
NEVER = set("head nav header footer aside script style noscript template iframe noembed noframes object svg math canvas audio video button select textarea input menu dialog fieldset".split())
CLOSES_P = BLOCK - set("body head html option optgroup caption tbody thead tfoot td th tr".split())
#: Words of class, id and role that mark what isn't main text. A token counts if it is one of them, or several of them and of
#: PLACES joined ("cookie-notice", "site-footer"); a token with any other part ("has-sidebar", "content-with-header") doesn't.
MARKS = set("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-social comment comments consent contentinfo cookie cookiebar cookies disqus feedback footer form gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices notification notifications overlay pagination pager popup promo promotion promoted related replies reply respond responses search share sharing signup sign-up sidebar side-bar skip social sponsor sponsored subscribe toolbar widget complementary alert alertdialog".split())
PLACES = set("site page main top bottom left right primary secondary global mobile desktop bar box list item link button icon".split())
#: Marks of elements whose articles are somebody else's: they don't reopen.
OTHERS = set("ad advert adverts advertisement advertising comment disqus promo promoted promotion related replies reply respond response responses sponsor sponsored".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|article-body|articlebody|post-content|entry-content|main-content|story-body|main)(?:$|\s)", re.IGNORECASE)
#: Possessive, and unquoted attributes hold no "<", so that a page without closing brackets takes linear time.
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\"<>]++)*+)>|<[!?][^<>]*+>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")

IN_ARTICLE, OPEN, OUT = 2, 1, 0
#: Inside an element that only its class, id or role marks; an article or main element there is REOPENED.
MARKED, REOPENED = -1, 3
#: Inside the header of an article: its headings are IN_ARTICLE, the rest (bylines, share buttons) is out.
HEADER = -2
#: Inside a form.
FORM = -3
#: Classes of an article's first paragraph, and elements of forms whose text is never main text. Fixed values.
LEADS = set("lead lede standfirst dek deck intro subtitle subheading excerpt".split())
CONTROLS = set("label legend datalist output".split())


def marks(token: str) -> set[str]:
    """The marks that a class, id or role token is made of; none if it has any other part."""
    one = lambda x: x if x in MARKS else x[:-1] if x.endswith("s") and x[:-1] in MARKS else None
    if one(token):
        return {one(token)}
    parts = [x for x in re.split(r"[_-]+", token) if x]
    found = {one(x) for x in parts} - {None}
    return found if all(one(x) or x in PLACES or x.rstrip("s") in PLACES for x in parts) else set()


def attribute_verdict(name: str, attributes: str, verdict: int) -> int:
    """Verdict of an element from its attributes, given that of its place."""
    values: dict[str, str] = {}
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        values.setdefault(key.lower(), a or b or c)
    if name not in ("html", "body") and ("hidden" in values or values.get("aria-hidden", "").strip().lower() == "true"):
        return OUT
    for key in ("class", "id", "role"):
        value = html.unescape(values.get(key, "")).lower()
        found = set().union(*(marks(x) for x in value.split()))
        if found and name not in ("html", "body", "article", "main"):
            return OUT if found & OTHERS or {x.rstrip("s") for x in found} & OTHERS else MARKED
        if verdict in (OPEN, FORM) and MAIN.search(value) and name in BLOCK:
            verdict = IN_ARTICLE if verdict == OPEN else REOPENED
    return verdict


def blocks(page: str) -> list[tuple[str, int]]:
    """Texts between block-level tags, decoded, with white space as one space, and their verdicts."""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int]] = []
    pending: list[str] = []
    forms: list[bool] = []  # of each form, whether it stands in an article's element
    at, n = 0, len(page)

    def level() -> int:
        return stack[-1][1] if stack else OPEN

    def close() -> None:
        text = " ".join(html.unescape("".join(pending)).split())
        if text:
            out.append((text, level(), len(forms) - 1))
        pending.clear()

    while at < n:
        m = TAG.search(page, at)
        if m is None:
            pending.append(page[at:])
            break
        pending.append(page[at : m.start()])
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name == "p" and depth is None:
                close()
            elif depth is not None:
                if any(x in BLOCK or v <= OUT and x not in ("b", "i", "a") for x, v in stack[depth:]):
                    close()
                del stack[depth:]
            continue
        attributes = m.group(3)
        verdict = level()
        if name in NEVER:
            verdict = HEADER if name == "header" and verdict == IN_ARTICLE and stack and any(x in ("article", "main") for x, _ in stack) else OUT
        elif verdict == HEADER:
            lead = name == "p" and bool(LEADS & set(re.findall(r"[\w-]+", " ".join(b or c or d for a, b, c, d in ATTRIBUTE.findall(attributes) if a.lower() == "class").lower())))
            verdict = IN_ARTICLE if lead or re.fullmatch("h[1-6]|hgroup", name) else HEADER
        elif name == "form" and verdict in (OPEN, IN_ARTICLE, FORM):
            close()
            if verdict != FORM:  # forms don't nest
                forms.append(verdict == IN_ARTICLE)
            found = attribute_verdict(name, attributes, FORM)
            verdict = FORM if found == REOPENED else found
        elif name == "form":
            verdict = OUT if verdict in (REOPENED, OUT) else verdict
        elif name in CONTROLS and any(x == "form" for x, _ in stack):
            verdict = OUT
        elif verdict != OUT and attributes:
            verdict = attribute_verdict(name, attributes, verdict)
        if name in ("article", "main"):
            verdict = {OPEN: IN_ARTICLE, MARKED: REOPENED, FORM: REOPENED}.get(verdict, verdict)
        if name in BLOCK or verdict != level():
            close()
        if name in CLOSES_P:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ("p", "article", "main", "section", "div", "td", "li", "blockquote", "body")), None)
            if depth is not None and stack[depth][0] == "p":
                del stack[depth:]
        if name in ("li", "dd", "dt", "option", "tr", "td", "th"):
            same = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in (*same, "ul", "ol", "dl", "table", "select", "tr")), None)
            if depth is not None and stack[depth][0] in same:
                del stack[depth:]
        if name == "br":
            pending.append(" ")
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if verdict > OUT:
                pending.append(page[at:stop])
            at = page.find(">", stop) + 1 if end else n
            at = at or n
            close()
            continue
        if not attributes.rstrip().endswith("/") or name in BLOCK:
            stack.append((name, verdict))
    close()
    # What reopened counts only where no article stands outside marked elements (teasers in a sidebar are articles too).
    reopened = OUT if any(v == IN_ARTICLE for _, v, _ in out) else IN_ARTICLE
    body = body_form(out)
    found = lambda v, form: (IN_ARTICLE if forms[form] else OPEN) if v == FORM and form == body else {MARKED: OUT, HEADER: OUT, FORM: OUT, REOPENED: reopened}.get(v, v)
    return [(text, found(v, form)) for text, v, form in out]


def body_form(found: list[tuple[str, int, int]]) -> int | None:
    """The form (text, verdict, form) that is the page's body; None if there is none."""
    if any(v in (IN_ARTICLE, REOPENED) for _, v, _ in found):
        return None
    sizes: dict[int, int] = {}
    for text, v, form in found:
        if v == FORM:
            sizes[form] = sizes.get(form, 0) + len(text)
    if not sizes:
        return None
    most = max(sizes, key=lambda k: (sizes[k], -k))
    others = sum(len(text) for text, v, form in found if v == OPEN or v == FORM and form != most)
    spoken = any(len(text.split()) >= MIN_REPEAT for text, v, form in found if v == FORM and form == most)
    return most if spoken and sizes[most] > others else None


def is_open(page: list[tuple[str, int]]) -> bool:
    return not any(v == IN_ARTICLE for _, v in page) and any(v == OPEN for _, v in page)


def repeated_tokens(tokens: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Tokens covered by a string of MIN_REPEAT tokens that starts on MIN_PAGES and PAGE_SHARE of the distinct pages.

    tokens are numbers, page ascends; strings don't cross pages. The suffix array is made by prefix doubling.
    """
    n = len(tokens)
    gone = np.zeros(n, bool)
    if n < MIN_REPEAT:
        return gone
    name = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    done, order = 1, np.argsort(name, kind="stable")
    while done < MIN_REPEAT:
        step = min(done, MIN_REPEAT - done)
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = np.where(page[step:] == page[:-step], name[step:], 0)
        key = name * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, np.int64)
        fresh[1:] = key[order][1:] != key[order][:-1]
        name[order] = np.cumsum(fresh)
        done += step
    # Neighbours in the array with one name share MIN_REPEAT tokens; count an interval's distinct pages.
    order = order[np.lexsort((page[order], name[order]))]
    first = np.ones(n, bool)
    first[1:] = (name[order][1:] != name[order][:-1]) | (page[order][1:] != page[order][:-1])
    pages = np.bincount(name[order], first)
    whole = np.zeros(n, bool)
    whole[: n - MIN_REPEAT + 1] = page[: n - MIN_REPEAT + 1] == page[MIN_REPEAT - 1 :]
    enough = max(MIN_PAGES, PAGE_SHARE * len(np.unique(page)))
    at = np.flatnonzero(whole & (pages[name] >= enough))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + MIN_REPEAT, -1)
    return np.cumsum(edge[:-1]) > 0


def unique_text(text: str, gone: np.ndarray) -> str:
    """An open block without its covered tokens; empty if that leaves only scraps of a block that is mostly covered."""
    if not gone.any():
        return text
    first, last = A.runs(~gone)
    if gone.mean() >= COVERED and (last - first).max(initial=0) < MIN_REPEAT:
        return ""
    return " ".join(w for w, g in zip(text.split(), gone, strict=True) if not g)


def settle(pages: list[list[tuple[str, int]]]) -> list[str]:
    """Main texts of all of one host's pages."""
    kept: list[list[str]] = []
    open_ = [is_open(p) for p in pages]
    gone = np.zeros(0, bool)
    starts: dict[tuple[int, int], int] = {}
    if any(open_):
        numbers: dict[str, int] = {}
        tokens, page = [], []
        distinct: dict[tuple, int] = {}
        for k, p in enumerate(pages):
            same = distinct.setdefault(tuple(p), k)
            if same != k:
                continue
            for b, (text, _) in enumerate(p):
                starts[k, b] = len(tokens)
                ids = [numbers.setdefault(w, len(numbers)) for w in text.split()]
                tokens += ids
                page += [k] * len(ids)
        gone = repeated_tokens(np.array(tokens, np.int64), np.array(page, np.int64))
    for k, p in enumerate(pages):
        if not open_[k]:
            kept.append([text for text, v in p if v == IN_ARTICLE])
            continue
        lead = distinct[tuple(p)]
        texts = []
        for b, (text, v) in enumerate(p):
            if v != OPEN:
                continue
            at = starts[lead, b]
            texts.append(unique_text(text, gone[at : at + len(text.split())]))
        kept.append([t for t in texts if t])
    return ["\n".join(x) for x in kept]


RESULT = "page_id long, url string, text string, n_chars long"
PARSED = "host long, page_id long, url string, digest binary, open boolean, texts array<string>, verdicts array<int>"


def results(rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
    columns = [pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def strings(pages: list[list[str]]) -> Iterator[np.ndarray]:
    """Per page (its blocks' texts) the hashes of its strings of MIN_REPEAT tokens, in order."""
    for part in A.slices(pa.array([" ".join(p) for p in pages], pa.string())):
        w = A.words(part, A.SPACES)
        grams = A.mix(A.ITEMS[0].windows(A.ITEMS[0].prefix(w.hashes()), MIN_REPEAT)).view(np.int64) if w.bounds[-1] >= MIN_REPEAT else np.zeros(0, np.int64)
        for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            yield grams[a : max(a, b - MIN_REPEAT + 1)]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [blocks(h or "") for h in batch.column("html").to_pylist()]
        digests = [hashlib.blake2b(repr(p).encode("utf-8", "surrogatepass"), digest_size=16).digest() for p in parsed]
        open_ = [is_open(p) for p in parsed]
        texts, verdicts = ([[x[k] for x in p] for p in parsed] for k in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("host", "page_id", "url")), pa.array(digests, pa.binary()), pa.array(open_, pa.bool_()), pa.array(texts, pa.list_(pa.string())), pa.array(verdicts, pa.list_(pa.int32()))],
            names=["host", "page_id", "url", "digest", "open", "texts", "verdicts"],
        )


def _structural(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STRUCTURAL rows: each page's text by structure alone, and whether it is open."""
    for batch in batches:
        parsed = [blocks(h or "") for h in batch.column("html").to_pylist()]
        texts = ["\n".join(t for t, v in p if v == IN_ARTICLE) for p in parsed]
        open_ = pa.array([is_open(p) for p in parsed], pa.bool_())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "page_id", "url")), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), open_], names=["host", "page_id", "url", "text", "n_chars", "open"])


def _strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(x) for x in strings(batch.column("texts").to_pylist())]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        if len(row):
            yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(row)), batch.column("digest").take(pa.array(row)), pa.array(np.concatenate(found))], names=["host", "digest", "string"])


def _uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "texts", "verdicts", "repeated", "open")), strict=True))
        out = []
        for (*_, texts, verdicts, repeated, open_), grams in zip(rows, strings([r[2] for r in rows]), strict=True):
            if not open_:
                out.append("\n".join(t for t, v in zip(texts, verdicts, strict=True) if v == IN_ARTICLE))
                continue
            bounds = np.concatenate([[0], np.cumsum([len(t.split()) for t in texts])])
            at = np.flatnonzero(np.isin(grams, np.array(repeated or [], np.int64)))
            gone = A.covered(at, at + MIN_REPEAT, bounds[-1])
            kept = [unique_text(t, gone[a:b]) for t, v, a, b in zip(texts, verdicts, bounds[:-1], bounds[1:], strict=True) if v == OPEN]
            out.append("\n".join(t for t in kept if t))
        yield results(rows, out)


def large_hosts_texts(rows: DataFrame) -> DataFrame:
    """RESULT of rows (host, page_id, url, html) whose hosts are too large for a task: their strings are counted by the cluster."""
    parsed = save(rows.mapInArrow(_parse, PARSED), "parsed")
    distinct = parsed.where(F.size("texts") > 0).dropDuplicates(["host", "digest"]).select("host", "digest", "open", "texts")
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = "host long, digest binary, string long"
    counts = distinct.mapInArrow(_strings_of, found).groupBy("host", "string").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_PAGES)
    repeated = save(counts.join(sizes, "host").where(F.col("n") >= F.lit(PAGE_SHARE) * F.col("pages")).select("host", "string"), "repeated")
    release(rows.sparkSession)
    hits = distinct.where("open").mapInArrow(_strings_of, found).join(repeated, ["host", "string"])
    lists = hits.groupBy("host", "digest").agg(F.collect_list("string").alias("repeated"))
    return parsed.join(lists, ["host", "digest"], "left").mapInArrow(_uncovered, RESULT)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (main text, blocks joined by line ends) and n_chars, one row per page."""
    small_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.xxhash64(host).alias("host"), F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    # Structure alone settles hosts without an open page: their texts are those of the first pass. The others' pages are counted by host.
    first = save(rows.mapInArrow(_structural, f"host long, {RESULT}, open boolean"), "structural")
    hosts = first.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("open"))
    hosts = save(hosts.where("open").select("host", "n"), "open-hosts")
    n_open, n_large = hosts.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > GROUP_PAGES, 1))).first()
    result = [c.split()[0] for c in RESULT.split(", ")]
    if not n_open:
        return first.select(*result)
    of = lambda some, how, what=rows: what.join(F.broadcast(some) if n_open <= MAX_HOSTS else some, "host", how)
    closed = of(hosts.select("host"), "left_anti", first).select(*result)
    small = of(hosts.where(F.col("n") <= GROUP_PAGES).select("host"), "left_semi")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def flush() -> pa.RecordBatch:
            return results(held, settle([blocks(h or "") for _, _, h in held]))

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("host", "page_id", "url", "html")), strict=True):
                if held and g != now:
                    yield flush()
                    held = []
                now = g
                held.append(tuple(row))
        if held:
            yield flush()

    out = small.repartition("host").sortWithinPartitions("host", "page_id", "url").mapInArrow(emit, RESULT)
    out = closed.unionByName(out)
    return out.unionByName(large_hosts_texts(of(hosts.where(F.col("n") > GROUP_PAGES).select("host"), "left_semi"))) if n_large else out


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))

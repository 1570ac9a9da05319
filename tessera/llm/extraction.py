"""HTML main text by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score above zero, tags below; how much, by the tag and
by the block that a word stands in, is learnt from labelled pages: those whose ``<article>`` or ``<main>`` says where their
content is. One linear scan finds the contiguous region of the greatest sum; a page of several articles gives every
maximal region that holds text of one. Blocks inside that are set apart by their own tag, class, role or whole id
(menus, forms, comments, notices, adverts, scripts) are left out, and the rest is joined in page order. A compound name
counts if all its words do or one can mean nothing else, so ``share-price`` is left to the scan; no name sets the page or
a heading apart, and a form or a named box around all articles of a page isn't one.

The weights come from counts over a bounded sample, ``MAX_TRAIN`` labelled pages chosen by a hash; keys (a tag, its class and the block it stands in) of which the sample holds fewer than
``MIN_COUNT`` words take the tag's weight in other blocks, or a fixed one. Extraction reads whole pages and has no shuffle.

Defined cases: null or empty html gives an empty text; markup that is cut off ends with the page; a quote that isn't
closed doesn't take text into its tag; unknown references stay as they are; without labelled pages fixed weights are
used; of equally good regions the first is taken; very long pages are read whole, in time that grows with their
length; repeated rows give equal texts; extra columns are carried along, but for ``text`` and ``n_chars``; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_TRAIN, MIN_COUNT = 2000, 20

# A quoted value stands behind "=" and doesn't hold "<": a quote that isn't closed before the next tag is no quote, and its tag ends at ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"<]*\"|'[^'<]*')|=)*+)(?:>|\Z)|([^<]+|<)", re.S)
_KINDS = re.compile(r"(?<![\w-])(?:class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# Elements by what they are for.
HIDDEN = frozenset("script style head noscript template svg iframe object canvas title textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav menu aside footer form dialog button".split())
# Words of names: these tell what a box is in whatever compound they stand ...
STRONG_WORDS = frozenset("advert advertisement sponsored breadcrumb breadcrumbs cookies newsletter disqus sidebar comments masthead navbar popup promo promoted".split())
# ... these only alone or beside words that tell the place or form of a box: a "share-price" is no "share-bar".
WEAK_WORDS = frozenset("ad ads banner comment cookie consent footer header menu nav navigation notice related share sharing social sponsor subscribe toolbar widget reply replies respond legal copyright disclaimer".split())
PLACE_WORDS = frozenset("area article articles bar block body bottom box button buttons center column container content desktop fixed form global group icon icons inner item items js left link links list main media mobile modal outer overlay page panel post posts primary right row secondary section site slot sticky top unit widget wrap wrapper".split())
OWN_WORDS = frozenset("header footer banner masthead legal copyright disclaimer".split())  # as names inside the article they are the article's own
REPLY_WORDS = frozenset("comment comments reply replies respond disqus related".split())  # an article below these isn't the page's
ID_WORDS = frozenset("footer header sidebar nav navbar navigation menu breadcrumbs comments disqus masthead toolbar".split())  # as the whole id of a box
BESIDE_WORDS = frozenset("has with no without".split())  # such a name says what stands beside or inside, not what this is
CONTENT = frozenset("html body main h1 h2 h3 h4 h5 h6".split())  # no name sets these apart
BOXES = frozenset("div section ul ol dl iframe center".split())
CONTAINERS = frozenset("html body article main section div header footer nav menu aside form dialog table blockquote figure fieldset details".split())
_ID = re.compile(r"(?<![\w-])id\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ARTICLE = re.compile(r"<article[\s>/]", re.I)


def _named(kinds: tuple[str, ...], inside: bool) -> set[str]:
    """The words by which a box's classes and roles set it apart."""
    out: set[str] = set()
    for name in kinds:
        words = {w for w in re.split(r"[-_]+", name) if w}
        if words & BESIDE_WORDS:
            continue
        found = words & (STRONG_WORDS | WEAK_WORDS)
        if inside:
            found -= OWN_WORDS
        other = {w for w in words - found if w not in PLACE_WORDS and w not in OWN_WORDS and len(w) > 1 and not any(c.isdigit() for c in w)}
        if found & STRONG_WORDS or (found and not other):
            out |= found
    return out


def _apart(tag: str, kinds: tuple[str, ...], inside: bool, ident: str = "") -> bool:
    """Whether an element sets its content apart, by its tag or, if it is a box of others, by words of its classes and
    roles or by its whole id; a ``header`` tag and names of heads and feet inside the article are the article's own, and
    no name sets a paragraph, an item or a heading apart."""
    if tag in CONTENT:
        return False
    if tag not in CONTAINERS and tag not in BOXES:
        return tag in APART
    if tag == "article":  # what a reader wrote, or a teaser
        return bool(_named(kinds, inside) & REPLY_WORDS)
    if tag in APART or (tag == "header" and not inside) or _named(kinds, inside):
        return True
    return tag in ("div", "ul", "ol") and ident in (ID_WORDS - OWN_WORDS if inside else ID_WORDS)


def _values(pattern: re.Pattern, attrs: str | None) -> tuple[str, ...]:
    return tuple(n.lower() for x in pattern.findall(attrs or "") for y in x if y for n in y.split())


def tokens(html: str) -> list[tuple]:
    """('tag', key, block, apart, in content) and ('text', key of the block around it, raw text, apart, in content).

    Content is what stands in an ``<article>`` or, on a page without one, in ``<main>``. Where a form or a named box
    stands around all articles of a page, it is no form or menu: it sets nothing apart."""
    content = "article" if _ARTICLE.search(html) else "main"
    out, free = _walk(html, content, False)
    if content == "article" and not free:
        lifted, free = _walk(html, content, True)
        return lifted if free else out
    return out


def _walk(html: str, content: str, lift: bool, names_apart: bool = True) -> tuple[list[tuple], int]:
    """The tokens, and how many articles aren't set apart. With ``lift`` the first article ends the marks around it, but not
    those of navigation, asides and replies; without ``names_apart`` only tags other than forms set apart."""
    out, stack, hidden, free = [], [], None, 0
    for m in _TOKEN.finditer(html):
        close, tag, attrs, text = m.groups()
        if tag:
            tag = tag.lower()
            if hidden:  # only its own end tag ends a hidden element; the end of a head is also where the body starts
                if close and tag == hidden:
                    hidden = None
                elif not (hidden == "head" and tag == "body"):
                    continue
                else:
                    hidden = None
            elif tag in HIDDEN and not close and not attrs.endswith("/"):
                hidden = tag
                continue
            if close:
                if any(e[0] == tag for e in stack):
                    while stack.pop()[0] != tag:
                        pass
                key = "/" + tag if tag in CONTAINERS else f"/{tag}@{stack[-1][1] if stack else ''}"
                out.append(("tag", key, tag in BLOCKS, stack[-1][2] if stack else False, bool(stack and stack[-1][3])))
                continue
            names = tuple(sorted(set(_values(_NAMES, attrs))))
            key = f"{tag}.{names[0]}" if names else tag
            if tag not in CONTAINERS:  # what a link or a list item means depends on what it stands in
                key = f"{key}@{stack[-1][1] if stack else ''}"
            if tag == "p" and stack and any(e[0] == "p" for e in stack):  # a paragraph ends the one before it
                while stack and stack.pop()[0] != "p":
                    pass
            kinds, ident = (_values(_KINDS, attrs), " ".join(_values(_ID, attrs))) if names else ((), "")
            inside = bool(stack and stack[-1][3])
            if tag == "article" and lift and not free and stack and stack[-1][2] and not any(e[4] for e in stack):
                stack = [(*e[:2], False, *e[3:]) for e in stack]
            own = _apart(tag, kinds, inside, ident) if names_apart else tag != "form" and _apart(tag, (), inside)
            apart = (bool(stack and stack[-1][2]) and tag != "main") or own
            free += tag == "article" and not apart
            out.append(("tag", key, tag in BLOCKS, apart, inside))
            if tag not in VOID and not attrs.endswith("/"):
                around = key if tag in CONTAINERS else (stack[-1][1] if stack else "")
                held = own and (tag in APART - {"form"} or ident in REPLY_WORDS or bool(_named(kinds, False) & REPLY_WORDS))
                stack.append((tag, around, apart, inside or tag == content, held))
        elif text and not hidden:
            out.append(("text", stack[-1][1] if stack else "", text, stack[-1][2] if stack else False, bool(stack and stack[-1][3])))
    return out, free


def count(html: str) -> Counter:
    """For each tag and each kind of block: words in it, or just behind it, inside and outside the article."""
    out: Counter = Counter()
    last: list[str] = []
    for t in tokens(html):
        if t[0] == "tag":
            last.append(t[1])
        elif n := len(t[2].split()):
            out["text", t[1], t[4]] += n
            for key in last:
                out["tag", key, t[4]] += n
            last = []
    return out


def _elsewhere(counts: Counter) -> Counter:
    """Counts of tags in any block that isn't set apart, for the same tags in blocks that the sample doesn't have."""
    out: Counter = Counter()
    for (kind, key, inside), n in counts.items():
        tag, _, around = key.partition("@")
        name, _, names = around.partition(".")
        if kind == "tag" and "@" in key and not _apart(name, (names,), True):
            out[kind, tag.partition(".")[0] + "@", inside] += n
    return out


def _weight(model: dict, key: str, apart: bool, inside: bool) -> float:
    """A tag's weight: as in such a block, else as in other blocks, else fixed. What is set apart inside the article is
    left out anyway and must not cut it in two: its tags weigh nothing. The other tags there cost no more than unknown
    ones: what mostly ends the articles of the sample doesn't end this one."""
    if apart and inside:
        return 0.0
    if inside:
        return max(_weight(model, key, False, False), -0.5)
    known, default = model["tag"], -6.0 if apart and key.split(".")[0].strip("/") in APART else -0.5
    return known.get(key, default if apart or "@" not in key else known.get(key.partition("@")[0].partition(".")[0] + "@", default))


def weights(counts: Counter) -> dict:
    """Words score by the share of content in such blocks; tags by how many words off content follow them."""
    counts = counts + Counter(_elsewhere(counts))

    def share(kind: str) -> dict[str, float]:
        keys = {k for a, k, _ in counts if a == kind}
        return {k: (counts[kind, k, True] + 0.5) / (counts[kind, k, True] + counts[kind, k, False] + 1) for k in keys if counts[kind, k, True] + counts[kind, k, False] >= MIN_COUNT}

    return {"text": {k: 0.02 + 0.98 * s**2 for k, s in share("text").items()}, "tag": {k: -0.1 - 8 * (1 - s) for k, s in share("tag").items()}}


DEFAULT = {"text": {"nav": 0.02, "footer": 0.02, "aside": 0.02, "form": 0.02}, "tag": {"nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0}}


def best(score: np.ndarray) -> tuple[int, int]:
    """The first of the contiguous regions of the greatest sum, as [start, end); (0, 0) if no sum is above zero."""
    # it ends where the running sum is furthest above its lowest value so far
    sums = np.concatenate([[0.0], np.cumsum(score)])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    if sums[end] - low[end] <= 0:
        return 0, 0
    return int(sums[: end + 1].argmin()), end


def maximal(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal regions: the best one, and then those of what stands before and behind it, in one scan with a stack
    of candidates, each (start, end, sum before it, sum with it, the last candidate with a lower sum before it)."""
    out: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for k, x in enumerate(score.tolist()):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = k, before
        while True:
            # candidates that start no lower than this one can't be its beginning
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            start, low = out[j][0], out[j][2]
            del out[j:]
        out.append((start, k + 1, low, total, j))
    return [c[:2] for c in out]


def _scores(found: list[tuple], model: dict) -> np.ndarray:
    score = np.zeros(len(found))
    for k, t in enumerate(found):
        if t[0] == "tag":
            score[k] = _weight(model, t[1], t[3], t[4])
        else:
            score[k] = 0.0 if t[3] and t[4] else len(t[2].split()) * model["text"].get(t[1], 0.05 if t[3] else 0.5)
    return score


def _regions(found: list[tuple], model: dict) -> list[tuple[int, int]]:
    """The best region and, of a page with several articles, the other maximal regions that hold text of one; no block is cut in two."""
    score = _scores(found, model)
    start, end = best(score)
    if not end:
        return []
    spans = [(start, end)]
    if sum(t[0] == "tag" and not t[3] and not t[4] and t[1].partition(".")[0] == "article" for t in found) > 1:
        spans += [(a, b) for a, b in maximal(score) if not (start <= a < end) and any(t[0] == "text" and t[4] and not t[3] for t in found[a:b])]
    whole: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        while start and not (found[start][0] == "tag" and found[start][2]) and not (found[start - 1][0] == "tag" and found[start - 1][2]):
            start -= 1
        while end < len(found) and not (found[end][0] == "tag" and found[end][2]):
            end += 1
        if whole and start < whole[-1][1]:
            start = whole.pop()[0]
        whole.append((start, end))
    return whole


def extract(html: str, model: dict) -> str:
    """The main text of a page."""
    found = tokens(html)
    text = _text(found, _regions(found, model))
    if not text and not any(t[0] == "tag" and t[1].partition(".")[0] in ("article", "main") for t in found):
        found = _walk(html, "main", False, names_apart=False)[0]  # a form or a name around the whole page
        text = _text(found, _regions(found, model))
    return text


def _text(found: list[tuple], regions: list[tuple[int, int]]) -> str:
    blocks: list[list[str]] = [[]]
    for start, end in regions:
        blocks.append([])
        for t in found[start:end]:
            if t[0] == "tag":
                if t[2]:
                    blocks.append([])
                elif re.match(r"/?br\b", t[1]):
                    blocks[-1].append(" ")
            elif not t[3]:
                blocks[-1].append(t[2])
    lines = (" ".join(unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> dict:
    rows = pages.filter(F.col(html_col).rlike(r"(?i)<(article|main)[\s>/]")).select(F.xxhash64(id_col, html_col).alias("h"), html_col)
    # hashes are chosen first, so that no page moves; repeated rows are one page of the sample and count each time
    chosen = F.broadcast(rows.select("h").distinct().orderBy("h").limit(MAX_TRAIN))
    chosen = rows.join(chosen, "h", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column(1).to_pylist():
                total += count(html or "")
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "key", "inside", "n"])

    sums = chosen.mapInArrow(work, "kind string, key string, inside boolean, n long").groupBy("kind", "key", "inside").agg(F.sum("n").alias("n"))
    got = Counter({(r["kind"], r["key"], r["inside"]): r["n"] for r in sums.filter(F.col("n") >= 1).collect()})
    return weights(got) if got else DEFAULT


def main_text(df: DataFrame, model: dict, html_col: str = "html") -> DataFrame:
    """``df`` without its html, with ``text`` and ``n_chars``."""
    df = df.drop(*({"text", "n_chars"} - {html_col}))
    at, shared = df.columns.index(html_col), df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [extract(h or "", shared.value) for h in part.column(at).to_pylist()]
                cols = [c for k, c in enumerate(part.columns) if k != at]
                names = [n for k, n in enumerate(part.schema.names) if k != at]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != html_col)
    return df.mapInArrow(work, f"{schema}, text string, n_chars long")


def op4_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return main_text(pages.select("page_id", "url", "html"), train(pages))

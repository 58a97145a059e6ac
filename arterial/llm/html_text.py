"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags. Pass 1 decides blocks: one in a
boilerplate container (menu, footer, sidebar, form, advert, notice, comments, ...) or
with mostly linked text is bad; a long one is good by its stop-word density, a short
one stays undecided. Inside an article or main element a block needs no stop words to
be good, as that element already marks it as content. Pass 2 gives every undecided block
the label of its nearest decided neighbours on both sides: good only if both are, where
there are both; neighbours are looked for within the same article, and one without any
decided block is good.

Null and empty html give an empty text. Character references are decoded; runs of
white space become one space; blocks are joined in page order by one space. Comments,
scripts and styles are skipped, also unclosed ones. Nothing is cut off, whatever
the page's length, and the time is in proportion to it: a tag's end is looked up, never
searched for anew. All other columns pass through, whatever their names, but for text
and n_chars, which are replaced. Repeated rows give equal rows, an empty table an empty one.
"""

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .exchange import small_batches

# Common function words of the languages of the corpus.
STOP_WORDS = frozenset(
    """
    a about after all also an and any are as at be because been but by can could did do for from had has have he her
    his how i if in into is it its just like more my no not now of on one only or other our out over she so some than that the
    their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer
    er es für hat haben ich ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so um und uns von vor war
    was wenn werden wie wir wird zu zum zur über
    au aux avec ce ces cette comme dans de des du elle en est et été il ils je la le les leur lui mais ne nous on ou où par pas
    plus pour qu que qui sa sans se ses si son sont sur tout un une vous y à
    al como con de del donde el ella en entre era es esta está este fue ha hay la las le lo los más me mi muy no nos o
    para pero por porque que se ser si sin sobre son su sus también te un una uno y ya
    """.split()
)
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What stands in these is never text of the article.
BOILERPLATE_TAGS = frozenset("nav footer aside form button dialog menu fieldset select datalist search".split())
RAW_TAGS = frozenset("script style noscript template textarea svg math iframe object audio video canvas title xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Whole words of a class, id or role.
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert(?:s|isement|isements|ising)?|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login"
    r"|side-?bar|widgets?|menus?|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|trending|comments?|commentlist|disqus|respond|replies|reply|skip-?link|search|complementary|contentinfo)(?:$|[^a-z])"
)
READER_COMMENT = re.compile(r"(?:^|[^a-z])(?:comments?|reply|replies|related|promo|ads?|sponsored)(?:$|[^a-z])")
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
#: The rest of a tag whose quoted values hold no angle brackets; it never looks beyond the next one.
PLAIN_END = re.compile(r"""[^<>"']*+(?:"[^"<>]*+"[^<>"']*+|'[^'<>]*+'[^<>"']*+)*+>""")
RAW_END = {tag: re.compile(rf"</{tag}[\s/]*>", re.IGNORECASE) for tag in RAW_TAGS}
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Limits:
    short_chars: int = 70  # shorter blocks are undecided
    long_chars: int = 200  # from here on a lower stop-word density is enough
    stop_low: float = 0.2
    stop_high: float = 0.3
    link_density: float = 0.33  # more linked characters than that: bad
    article_link_density: float = 0.6


@dataclass
class Block:
    article: int = 0  # 0: outside of any
    boilerplate: bool = False
    heading: bool = False
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    good: bool | None = None


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    names = READER_COMMENT if tag == "article" else BOILERPLATE_NAMES
    return any(names.search("".join(found).lower()) for found in NAMED.findall(attributes))


class _Ends:
    """Where the tags of a page end, by the rule that a quote after an equals sign hides what stands before the next such quote."""

    def __init__(self, page: str):
        self.page, self.last, self.at = page, page.rfind(">"), None

    def _table(self) -> None:
        """For each bracket and quote, read outside of a value: the bracket that ends the tag."""
        self.at = [m.start() for m in re.finditer("[>\"']", self.page)]
        self.closing, following = [-1] * (len(self.at) + 1), {"\"": -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            c, before = self.page[self.at[i]], self.at[i] - 1
            if c == ">":
                self.closing[i] = self.at[i]
                continue
            while before >= 0 and self.page[before].isspace():
                before -= 1
            opens = before >= 0 and self.page[before] == "=" and following[c] >= 0
            self.closing[i] = self.closing[following[c] + 1] if opens else self.closing[i + 1]
            following[c] = i

    def after(self, at: int) -> int:
        """The place after the tag that has begun, or -1 if it doesn't end."""
        if m := PLAIN_END.match(self.page, at):
            return m.end()
        if at > self.last:
            return -1
        if self.at is None:
            self._table()
        end = self.closing[bisect_left(self.at, at)]
        return (end if end >= 0 else self.page.index(">", at)) + 1


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start and end of all markup, its tag ("": none), whether that closes, and its attributes."""
    ends, at = _Ends(page), page.find("<")
    while at >= 0:
        m = OPENING.match(page, at)
        end, tag, attributes = -1, "", ""
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark, close = ("<!--", "-->") if page[at + 2] == "-" else ("<![CDATA[", "]]>")
            end = page.find(close, at + len(mark))
            end = len(page) if end < 0 else end + len(close)
        elif m and m[2]:
            tag, end = m[2].lower(), ends.after(m.end())
            attributes = page[m.end() : max(end - 1, m.end())]
            if end >= 0 and not m[1] and tag in RAW_TAGS:
                raw = RAW_END[tag].search(page, end)
                tag, end = "", raw.end() if raw else len(page)
        elif m and at < ends.last:
            end = page.index(">", at) + 1
        if end < 0:
            at = page.find("<", at + 1)
            continue
        yield at, end, tag, bool(m[1]), attributes
        at = page.find("<", end)


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements that matter: name, are they boilerplate, do they hold the article
    opened: Counter = Counter()
    articles = bad = links = floor = 0  # below the floor of the stack nothing counts as boilerplate
    inside: list[int] = []
    heading = False
    block = Block()

    def finish() -> None:
        nonlocal block
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            block.text = text
            out.append(block)
        block = Block(inside[-1] if inside else 0, bad > 0, heading)

    def add(text: str) -> None:
        if text:
            block.parts.append(text)
            if links:
                block.linked += len(" ".join(text.split()))

    at = 0
    for start, end, tag, closes, attributes in _tags(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            block.parts.append(" ")
        elif tag == "a":
            links = 0 if closes else 1
        elif closes:
            depth = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag) if opened[tag] else None
            if tag in BLOCK_TAGS or (depth is not None and depth >= floor and stack[depth][1]):
                links = 0
                heading = False
            else:
                tag = ""
            while depth is not None and len(stack) > depth:
                name, was_bad, holds = stack.pop()
                opened[name] -= 1
                if tag:
                    bad -= was_bad and len(stack) >= floor
                    if holds:
                        inside.pop()
            floor = min(floor, len(stack))
            if tag:
                finish()
        elif tag not in VOID_TAGS:
            boilerplate = _is_boilerplate(tag, attributes, bool(inside))
            content = tag in CONTENT_TAGS and not boilerplate
            if content:
                # content begins: menus that were left open before it end here
                if not inside:
                    floor, bad = len(stack), 0
                articles += 1
                inside.append(articles if len(inside) == 0 else inside[-1])
            if tag in BLOCK_TAGS or boilerplate:
                if tag != "p":
                    stack.append((tag, boilerplate, content))
                    opened[tag] += 1
                    bad += boilerplate
                heading = tag in HEADINGS
                if tag in BLOCK_TAGS:
                    links = 0
                finish()
                if tag == "p" and boilerplate:
                    block.boilerplate = True
        elif tag == "hr":
            finish()
    # what is left may end in the middle of a tag
    tail = page[at:]
    cut = tail.rfind("<")
    add(tail if cut < 0 or not re.match(r"</?[a-zA-Z!]", tail[cut:]) else tail[:cut])
    finish()
    return out


def first_pass(block: Block, limits: Limits) -> bool | None:
    if block.boilerplate:
        return False
    size = len(block.text)
    if block.linked > size * (limits.article_link_density if block.article else limits.link_density):
        return False
    if size < limits.short_chars or block.heading:
        return None
    if block.article:
        return True
    words = WORD.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density >= limits.stop_high or (size >= limits.long_chars and density >= limits.stop_low):
        return True
    return None if density >= limits.stop_low else False


def second_pass(blocks: list[Block]) -> None:
    """Undecided blocks take the label of their nearest decided neighbours of the same article."""

    def nearest(order: list[int]) -> dict[int, bool | None]:
        last: dict[int, bool] = {}
        found = {}
        for i in order:
            b = blocks[i]
            if b.good is None:
                found[i] = last.get(b.article)
            elif not (b.article and not b.good):
                last[b.article] = b.good
        return found

    before, after = nearest(list(range(len(blocks)))), nearest(list(range(len(blocks) - 1, -1, -1)))
    for i, left in before.items():
        labels = [x for x in (left, after[i]) if x is not None]
        if blocks[i].heading and not blocks[i].article and after[i] is not None:
            labels = [after[i]]  # a heading belongs to what follows
        blocks[i].good = all(labels) if labels else bool(blocks[i].article)


def main_text(page: str | None, limits: Limits = Limits()) -> str:
    blocks = blocks_of(page or "")
    for b in blocks:
        b.good = first_pass(b, limits)
    second_pass(blocks)
    return " ".join(b.text for b in blocks if b.good)


def _extractor(column: int, limits: Limits):
    def extract(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            texts = [main_text(page, limits) for page in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names, "text", "n_chars"])

    return extract


def extract_text(df: DataFrame, page: str = "html", limits: Limits = Limits()) -> DataFrame:
    """df plus text and n_chars (code points); columns of df with these names are replaced. One pass, no shuffle."""
    small_batches(df.sparkSession)
    df = df.drop(*(c for c in ("text", "n_chars") if c != page))
    schema = T.StructType([*df.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return df.mapInArrow(_extractor(df.columns.index(page), limits), schema)

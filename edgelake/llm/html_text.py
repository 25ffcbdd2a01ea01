"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by their place (navigation, forms and the
like), their link density, length and density of stop words; short blocks and those with few stop words stay open. In the
second pass open blocks take the label of the nearest decided blocks of the same region.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgelake.llm.words import slices

LENGTH_LOW = 70
LENGTH_HIGH = 200
STOP_HIGH = 0.32
MAX_LINKS = 0.2

STOP_WORDS = frozenset(
    """the of and to a in is it that for on was with as are be this by at from or an not have but had his they i me my we us
    our ours you your yours he him she her hers its them their theirs what which who whom whose these those am were been being
    has having do does did doing would should could can will shall may might must if because until while about against between
    into through during before after above below up down out off over under again further then once here there when where why
    how all any both each few more most other some such no nor only own same so than too very just also now one two like
    de la le et les des un une en du que qui est dans pour au aux par sur pas ne se ce il elle avec plus l d s n c j m t qu
    je tu nous vous ils elles on me te lui leur leurs mon ma mes ton ta tes son sa ses notre nos votre vos cette cet ces cela
    ça ou où mais donc or ni car si comme quand dont y sont était étaient être été avoir a ai as avons avez ont avait avaient
    fait faire peut sans sous entre vers chez après avant aussi très bien tout tous toute toutes même autre autres encore
    depuis pendant ainsi alors
    der die das und ist ein eine zu den von mit auf für im dem nicht des auch sich als es an werden aus er in am um so wie
    ich du wir ihr sie mich dich uns euch mir dir ihm ihn ihnen mein meine sein seine seinen seiner ihre ihren ihrer unser
    einen einem einer eines dass daß oder aber wenn weil ob denn doch noch nur schon sehr mehr kann können wird wurde wurden
    war waren sind hat haben hatte hatten bei nach vor über unter durch gegen ohne bis seit zwischen zum zur vom beim diese
    dieser dieses diesem diesen jede jeder jedes alle alles was wer wo hier da dann man kein keine
    el los las y del por con una su para al lo como más o pero sus yo tú él ella nosotros ellos ellas me te nos les mi mis tu
    tus este esta estos estas ese esa esos esas eso esto aquel aquella no ni sí si cuando donde quien quienes cual porque
    aunque desde hasta entre sobre sin también muy ya todo toda todos todas otro otra otros otras ha han había habían he hay
    ser es son era eran fue fueron está están estaba tiene tienen puede se le un a e u
    il lo gli i di che è un uno per non con del della dei delle al alla ai alle nel nella da dal dalla sul sulla si come più
    ma anche sono era ha hanno questo questa questi queste quello quella o se perché loro suo sua suoi tra fra
    os as um uma do da dos das no na nos nas em ao aos à às pelo pela que e não com por para mais mas foi são ser está ele
    ela eles seu sua seus suas ou quando muito já também só até isso isto este essa esse entre depois sem mesmo
    het een van dat die is zijn op te aan niet met voor er maar om hij ze zij ook als naar bij uit dan wat nog wel geen
    werd worden heeft hebben kan deze dit door over""".split()
)
SKIPPED = frozenset("script style noscript template svg math iframe object select textarea title button canvas video audio head".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
FURNITURE = frozenset("nav footer aside form dialog menu fieldset".split())
MAIN = frozenset("article main".split())
BLOCKS = frozenset(
    """address blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li
    ol p pre section summary table tbody td tfoot th thead tr ul header article main nav footer aside form dialog menu
    fieldset""".split()
)
CONTAINERS = frozenset("div section body center".split())
SHORT_LIVED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr".split())
MARKS = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertis\w*|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|footer|comments?"
    r"|commentlist|comment\w*|disqus\w*|repl(?:y|ies)|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscri\w*|signup"
    r"|login|share|sharing|social|related|recommend\w*|widgets?|pag(?:er|ination)|masthead|toolbar|skip)(?=$|[^a-z])"
)
HEADERS = re.compile(r"(?:^|[^a-z])header(?=$|[^a-z])")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[^<]+|<""",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A block of text: its region (a number, and whether it is main text or page furniture) and its label.

    A bare block stands in a container, not in a paragraph, heading, list or table cell of its own.
    """

    region: int
    main: bool
    furniture: bool
    bare: bool = False
    parts: list[str] = field(default_factory=list)
    links: int = 0
    text: str = ""
    label: bool | None = None


def blocks(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = []
    opened_tags: Counter[str] = Counter()
    region, links, at = (0, False, False), 0, 0
    regions, current, wait = 0, Block(*region), ""

    def flush() -> Block:
        text = " ".join("".join(current.parts).split())
        if text:
            current.text = text
            found.append(current)
        return Block(*region)

    def close() -> str:
        tag = stack.pop()[0]
        opened_tags[tag] -= 1
        return tag

    while match := TOKEN.match(page, at):
        at = match.end()
        tag = match["tag"]
        if tag is None:
            piece = match[0]
            if piece.startswith(("<!", "<?")):
                continue
            piece = html.unescape(piece)
            current.parts.append(piece)
            if links:
                current.links += len(piece.strip())
            continue
        tag, ending = tag.lower(), bool(match["end"])
        if tag in SKIPPED and not ending:
            if not match["rest"].endswith("/"):
                at = _after(page, tag, at)
            continue
        if tag == "a":
            links = 0 if ending else 1
            continue
        if tag == "br":
            current.parts.append(" ")
            continue
        if tag not in BLOCKS:
            continue
        if not ending and tag in SHORT_LIVED and stack and stack[-1][0] == tag:
            close()
        elif not ending and wait and tag in BLOCKS and stack and stack[-1][0] == "p":
            close()
        if ending:
            while opened_tags[tag] and close() != tag:
                pass
        elif tag not in VOID:
            now = stack[-1] if stack else ("", 0, False, False)
            marked = tag in FURNITURE or _marked(tag, match["rest"], now[2])
            if tag not in SHORT_LIVED or marked:
                opened = tag in MAIN or marked
                regions += opened
                opened_tags[tag] += 1
                stack.append((tag, regions if opened else now[1], now[2] or tag in MAIN, now[3] or marked))
        links = 0
        region = stack[-1][1:] if stack else (0, False, False)
        wait = "p" if stack and stack[-1][0] == "p" else ""
        current = flush()
        current.bare = ending or tag in CONTAINERS
    flush()
    return found


def _after(page: str, tag: str, at: int) -> int:
    """Where the content of a skipped element ends; an unclosed head or raw element ends at the body or the page."""
    end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
    if tag == "head":
        body = re.compile(r"<body\b", re.I).search(page, at)
        if body and (not end or body.start() < end.start()):
            return body.start()
    if end:
        return end.end()
    return len(page) if tag in RAW else at


def _marked(tag: str, rest: str, in_main: bool) -> bool:
    """Whether an element's role, class or id says that it is page furniture."""
    if tag in ("html", "body") or tag in MAIN:
        return False
    if tag == "header" and not in_main:
        return True
    for name, *values in NAMED.findall(rest):
        value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", "".join(values)).lower()
        if value in ROLES if name.lower() == "role" else MARKS.search(value) or (not in_main and HEADERS.search(value)):
            return True
    return False


def classify(found: list[Block]) -> list[Block]:
    """Label blocks in two passes; ``label`` is true for main text.

    A long block with many stop words is main text by itself; with few it stays open, for it may be of a language that
    has no list here, and only its place and links can speak against it. With an article in the page, blocks outside it
    need a decision of their own; inside it only links speak against a block, and say nothing of its neighbours. A block
    that has no decided neighbour in its region is main text, but for bare blocks up to ``LENGTH_HIGH`` in pages without an
    article: these follow the nearest decided block of the whole page, and when two are as near, both must be main text.
    """
    has_main = any(b.main and not b.furniture for b in found)
    for b in found:
        size = len(b.text)
        if b.furniture or b.links > MAX_LINKS * size:
            b.label = False
        elif size >= LENGTH_LOW:
            tokens = LETTERS.findall(b.text.lower())
            stops = sum(t in STOP_WORDS for t in tokens) / max(1, len(tokens))
            if stops >= STOP_HIGH and size > LENGTH_HIGH:
                b.label = True
    decided = [None if b.main and b.label is False else b.label for b in found]
    inside, anywhere = _nearest([b.region for b in found], decided), _nearest([0] * len(found), decided)
    for i, b in enumerate(found):
        if b.label is None and b.bare and not has_main and len(b.text) <= LENGTH_HIGH:
            b.label = all(anywhere[i])
        elif b.label is None:
            b.label = (not inside[i] or any(inside[i])) and (b.main or not has_main)
    return found


def _nearest(regions: list[int], decided: list[bool | None]) -> list[list[bool]]:
    """For each block the labels of the nearest decided blocks of its region: two when they are as near, none without any."""
    near: list[list[tuple[int, bool]]] = [[] for _ in regions]
    for order in (range(len(regions)), range(len(regions) - 1, -1, -1)):
        last: dict[int, int] = {}
        for i in order:
            if (j := last.get(regions[i])) is not None:
                near[i].append((abs(i - j), decided[j]))
            if decided[i] is not None:
                last[regions[i]] = i
    return [[label for distance, label in found if distance == min(found)[0]] for found in near]


def main_text(page: str) -> tuple[str, int, int]:
    """Main text of a page, one line per block; the numbers of its blocks and of those kept."""
    found = classify(blocks(page))
    kept = [b.text for b in found if b.label]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every row: page_id, url, text, n_chars, n_blocks, n_kept.

    A null, empty or blank page has an empty text. Markup that is not closed ends with its parent or the page.
    Repeated rows stay repeated; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                texts = [main_text(page or "") for page in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1),
                        pa.array([t for t, _, _ in texts], pa.string()),
                        pa.array([len(t) for t, _, _ in texts], pa.int64()),
                        pa.array([n for _, n, _ in texts], pa.int64()),
                        pa.array([k for _, _, k in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"],
                )

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, "page_id bigint, url string, text string, n_chars bigint, n_blocks bigint, n_kept bigint"
    )

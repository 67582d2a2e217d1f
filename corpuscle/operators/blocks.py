"""A page's headings, paragraphs and list items in document order, by a fold of its tags over a stack of open elements."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuscle.functions.text import text_of

# What becomes a block, and how long a paragraph or list item is at least.
HEADS, TEXTS, LEAST = ("h1", "h2", "h3", "h4"), ("p", "li"), 40
ANY_HEAD, LISTS = (*HEADS, "h5", "h6"), ("ul", "ol")
#: Elements whose start or end closes an open paragraph, by the rules of HTML.
CLOSERS = ("address", "blockquote", "body", "center", "dd", "dir", "div", "dl", "dt", "fieldset", "form", "hr", "menu", "pre", "table", "tbody", "td", "tfoot", "th", "thead", "tr")
TOKENS = r"(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|[^<]+|<"


def without(html: Column, *tags: str) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return html


def is_text(token: Column) -> Column:
    return ~token.startswith("<") | (token == "<")


def joined(tokens: Column) -> Column:
    """The text of tokens: a space between pieces, references decoded, white space of any kind collapsed."""
    from corpuscle.operators.site import decoded

    return F.trim(F.regexp_replace(decoded(F.array_join(F.filter(tokens, is_text), " ")), r"(?U)\s+", " "))


TOKEN, TAG = re.compile(TOKENS), re.compile("</?([a-zA-Z][a-zA-Z0-9]*)")


def spans(html: str) -> list[tuple[int, int, str]]:
    """``at, end, tag`` of a page's blocks as numbers of its tokens, in the order in which they start; -1 is behind the last.

    What a tag closes ends with all above it in the stack of open elements; a block or list
    that it opens goes on top. Each tag's places in the stack are kept, so a tag costs the
    same in a deep stack.
    """
    stack, done, places = [], [], {tag: [] for tag in (*ANY_HEAD, *TEXTS, *LISTS)}
    last = lambda *names: max((places[x][-1] for x in names if places[x]), default=-1)
    for at, token in enumerate(TOKEN.finditer(html)):
        name = TAG.match(token[0])
        tag, opens = name and name[1].lower(), not token[0].startswith("</")
        if tag not in places and tag not in CLOSERS:
            continue
        if tag in LISTS and not opens:
            cut = last(tag)
        elif tag == "li":
            cut = last("li")
            if cut <= last(*LISTS):
                cut = last("p") if opens else -1
        elif tag in ANY_HEAD:
            cut = last(*ANY_HEAD)
            if cut < 0 and opens:
                cut = last("p")
        else:
            cut = last("p")
        while cut >= 0 and len(stack) > cut:
            name, start = stack.pop()
            places[name].pop()
            done.append((start, at, name))
        if opens and tag in places:
            places[tag].append(len(stack))
            stack.append((tag, at))
    done += [(start, -1, name) for name, start in stack]
    return sorted(x for x in done if x[2] in HEADS or x[2] in TEXTS)


def folded(html: pd.Series) -> pd.Series:
    return html.map(spans)


def page_blocks(pages: DataFrame, *keep: str, html_col: str = "html") -> DataFrame:
    """``keep`` and ``blocks``: structs of kind (``h`` or ``p``), level (of a heading, else 0) and text, in the order in which they start.

    h1 to h4 are headings, p and li of 40 characters and more paragraphs; a paragraph in a
    list item counts as both. Scripts, styles and drawings are left out; elements without
    an end tag end where HTML ends them. Empty blocks are left out; null markup has none.
    """
    html = without(text_of(html_col), "script", "style", "noscript", "svg")
    # Markup is dealt to all tasks before it is read: a small file would be one task's.
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(*keep, html.alias("_h")).repartition(tasks, "_h").withColumn("_s", F.pandas_udf(folded, "array<struct<at:int,end:int,tag:string>>")("_h"))
    rows = rows.select(*keep, "_s", F.regexp_extract_all("_h", F.lit(TOKENS), F.lit(0)).alias("_t"))
    # Elements that are open at the end end behind the last token.
    found = F.transform("_s", lambda x: F.struct(x["at"].alias("at"), F.when(x["end"] < 0, F.size("_t")).otherwise(x["end"]).alias("end"), x["tag"].alias("tag")))
    head = lambda x: x["tag"].isin(*HEADS)
    blocks = F.transform(
        found,
        lambda x: F.struct(F.when(head(x), "h").otherwise("p").alias("kind"), F.when(head(x), F.substring(x["tag"], 2, 1).cast("int")).otherwise(0).alias("level"), joined(F.slice(F.col("_t"), x["at"] + 2, x["end"] - x["at"] - 1)).alias("text")),
    )
    long = F.filter(blocks, lambda b: (b["text"] != "") & ((b["kind"] == "h") | (F.char_length(b["text"]) >= LEAST)))
    return rows.select(*keep, long.alias("blocks"))

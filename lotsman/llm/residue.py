"""Template residue, filler text, error pages and script notices that stand where content should be.

Texts are read as passages (lines, then sentences).  A span of the shape of an unfilled place is a seed; the words
beside it are its frame, and passages of one frame are aligned over the corpus.  Where what stands in the frame's slot
varies, the frame is a template and the slot is induced: seeds in it are residue, and so is any code-like span in it,
in whatever notation.  A frame that always holds the same span
is prose about it.  What no other record aligns with is decided by where it stands in its passage.  Messages count
where a passage is the message.  Whole pages that repeat over documents but for identifiers and digits are page
templates; those that hold an identifier that changes from copy to copy are made by machine, not content.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotsman.session import salt, stash

#: Names of the ways in which an unfilled place is written, with their patterns.
SLOTS = {
    "mustache": r"\{\{[^{}\n]{0,80}\}\}",
    "block": r"\{%[^%\n]{0,80}%\}",
    "erb": r"<%=?[^%\n]{0,80}%>",
    "dollar": r"\$\{[^{}\n]{1,80}\}",
    "hash": r"#\{[^{}\n]{1,80}\}",
    "at": r"@@[\w.\- ]{1,60}@@",
    "wiki": r"\[\[[^\[\]\n]{1,80}\]\]",
    "chevron": r"<<[^<>\n]{1,80}>>",
    "percent": r"%[A-Z][A-Z0-9_.]{2,60}%",
    "dunder": r"__[A-Z][A-Z0-9_]*?[A-Z0-9]__",
    "question": r"\?[A-Z][A-Z0-9_.]{2,60}\?",
    "tag": r"<[a-z][\w\-.]{1,60}\s?/>",
    "number": r"(?<![\w^_}])\{\d{1,2}\}",
    "brace": r"(?<![\w\\^_])\{[^\W\d_][^{},;:|\n]{2,60}\}",
    "bracket": r"(?<![\w\]])\[[^\W\d_][^\[\],;|\n]{2,60}\]",
    "angle": r"<[^\W\d_][^<>,;|/=\n]{2,60}>",
    "error": r"#(?:REF!|VALUE!|NAME\?|DIV/0!|NUM!|NULL!|N/A|ЗНАЧ!|ССЫЛКА!|ИМЯ\?|ДЕЛ/0!|ЧИСЛО!|Н/Д)",
    "date": r"\b[XХ]{2}\.[XХ]{2}\.(?:20)?[XХ]{2,4}\b|(?<!\w)ДД\.ММ\.ГГГГ\b|\bDD\.MM\.YYYY\b",
    "blank": r"«\s*(?:_{2,}[^»\n]{0,60}_{2,}|[_…\s]*…[_…\s]*|(?:\.\s?){5,})\s*»",
    "prompt": r"«[^»\n]{0,60}\b(?:вписать|вставить|указать|заполнить)\b[^»\n]{0,40}»|\((?i:вставить|указать|вписать|заполнить)[^()\n]{1,60}\)(?:\s*TODO)?|\bTODO\b|\bTBD\b|\bВведите [а-яё]+|Щ[её]лкните здесь, чтобы ввести [а-яё]+|\bClick (?:or tap )?here to enter [a-z]+|\bEnter [a-z]+ here\b",
    "value": r"\bundefined\b|\bNaN\b|\bnull\b|(?<=: )None\b",
}
SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SLOTS.items()))
#: Beginnings of messages that stand for a page that could not be shown, and of script notices.
MESSAGES = re.compile(
    r"""(?:
    (?:error\s*[:\-]?\s*)?\d{3}\s*[:\-–—]?\s*(?:forbidden|not\ found|bad\ (?:gateway|request)|service\ (?:temporarily\ )?unavailable|internal\ server\ error|gateway\ time-?out|unauthorized|too\ many\ requests|страница\ не\ найдена|доступ\ запрещ[её]н)\b
    |(?:ошибка|error)\s*\#?\s*[45]\d\d\b
    |error\s*:\s.*\b(?:could\ not|cannot|failed|unable|not\ found)\b
    |(?:404\s+)?страница\ не\ найдена\b
    |page\ not\ found\b|access\ denied\b|service\ (?:temporarily\ )?unavailable\b
    |внутренняя\ ошибка\ сервера\b|internal\ server\ error\b
    |превышено\ время\ ожидания\b|(?:request|connection|gateway)\ timed?[\ -]?out\b
    |(?:сервис|сайт|сервер|страница)\ временно\ недоступ
    |(?:время\ (?:сеанса|сессии)|сеанс|сессия)\ (?:истек|ист[её]к)
    |(?:your\ )?session\ (?:has\ )?(?:expired|timed\ out)\b
    |не\ удалось\ (?:загрузить|открыть|отобразить|получить|подключиться)\b
    |доступ\ (?:запрещ[её]н|ограничен)\b
    |подозрительная\ активность\b|(?:пожалуйста,\ )?подтвердите,\ что\ вы\ не\ робот
    |(?:please\ )?(?:verify|confirm)\ (?:that\ )?you\ are\ (?:not\ a\ robot|human)
    |для\ (?:работы|просмотра|отображения|корректной)\b.*(?:включит|необходим|требует|нуж).*(?:javascript|скрипт|сценари)
    |(?:пожалуйста,\ )?(?:включите|разрешите)\ (?:javascript|(?:выполнение\ )?(?:скриптов|сценариев)|скрипты|сценарии|поддержку)\b
    |(?:в\ )?(?:ваш(?:ем)?\ )?браузере?\ (?:не\ поддерживает|отключ[её]н[аы]?)\ .*(?:сценари|скрипт|javascript)
    |(?:выполнение\ (?:скриптов|сценариев)|поддержка\ (?:скриптов|сценариев)|javascript)\ (?:отключен[оаы]?|выключен[оаы]?)\b
    |(?:эта|данная)\ страница\ требует\b.*(?:скрипт|сценари|javascript|cookies)
    |(?:please\ |you\ (?:need|have|must)\ (?:to\ )?)(?:enable|turn\ on|allow|activate)\ (?:javascript|scripts|cookies)\b
    |(?:javascript|scripts?)\ (?:is|are|must\ be|has\ to\ be)\ (?:disabled|required|enabled)\b
    |if\ the\ page\ does\ not\ (?:open|load)\b.*(?:scripts|javascript|cookies)
    |this\ (?:site|page|app)\ (?:requires|needs|works\ best\ with)\ (?:javascript|scripts)
    |(?:[a-z]\w*\.){2,}\w*(?:exception|error)\b
    |at\ [\w.$]+\([\w]+\.java:\d+\)
    |traceback\ \(most\ recent\ call\ last\)
    |file\ "[^"]+",\ line\ \d+,\ in\b
    |(?:key|type|value|attribute|name|index|runtime)error:\ \S
    |(?:fatal\ error|warning|notice):\ .*\bon\ line\ \d+
    )""",
    re.I | re.X,
)
FISH = re.compile(r"(?:рыба-?\s?текст|текст-?\s?рыба|здесь будет текст|абзац заполнен условными словами|текст[- ]заполнитель|placeholder text|sample text goes here)\b", re.I)
MASH = frozenset("asdf qwerty qwer zxcv йцукен фыва ячсм тест test".split())  # fixed values: words typed to fill space
BREAK = re.compile("[\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\Wa-zа-яё_]|[«\"({\[<#@$%_?])")
BULLET = re.compile(r"^\s*(?:[-*•–—·]\s+|\d+(?:\.\d+)*[.)]\s+|\d+(?:\.\d+)+\s+)")
WORD = re.compile(r"[^\W\d_]{2,}")
TOKEN = re.compile(r"\w+")
#: A text or passage without any of these has no slot.
SLOT_SIGNS = tuple("{ < [ # @@ XX. ХХ. ДД. DD. TODO TBD Введите Enter undefined NaN null None вписать вставить указать заполнить ВПИСАТЬ ВСТАВИТЬ УКАЗАТЬ ЗАПОЛНИТЬ Вписать Вставить Указать Заполнить".split()) + ("кните здесь", "ere to enter")
RARE_SIGNS = (("__", re.compile("__[A-Z]")), ("%", re.compile("%[A-Z]")), ("?", re.compile(r"\?[A-Z]")), ("«", re.compile(r"«\s*[_….]")))
#: A text without any of these, in lower case and with single spaces, has no message, or no filler.
MESSAGE_SIGNS = tuple("forbidden,not found,gateway,unavailable,unauthorized,too many,bad request,не найдена,запрещ,доступ ограничен,ошибка,error,exception,истек,истёк,не удалось,подозрительная,не робот,a robot,human,script,скрипт,сценари,поддержку,cookies,traceback,недоступ,превышено,timed,time out,time-out,timeout,.java:,denied,expired,file \",on line".split(","))
FILLER_SIGNS = tuple("lorem ipsum,xxx,ххх,aaa,ааа,zzz,рыба,будет текст,условными словами,заполнитель,placeholder,sample text,asdf,qwer,йцукен,фыва,zxcv,тест тест,test test".split(","))
MASK = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
SAME = re.compile(r"([^\W\d_])\1{2,}")
#: Words outside slots up to which a passage that no other aligns with is a filled-in line.
FRAME_WORDS = 5
#: Words of a passage from which on it is filler where it has four times as many words as different ones.
MONOTONE = 8
#: Of a frame's residues, the largest share that one value may have if the slot is to vary.
SAME_SHARE = 0.5
#: Records of a page that must differ in an identifier.
PAGE_COPIES = 2
#: Code points up to which a text with a message is an error page; in a longer one half of the passages are messages.
PAGE = 600
_SYMBOL = r"[{}\[\]<>#@$%&*_=~^\\?!+]{1,4}"
#: A code-like span in any notation: words between symbols, a compound name, or a run of one sign.
ODD = re.compile(rf"{_SYMBOL}\s?[^\W\d][\w.\- ]{{1,60}}?\s?{_SYMBOL}|\b[A-Za-z]+(?:_[A-Za-z0-9]+)+\b|[_*~=#]{{3,}}|(?:\.\s?){{5,}}|…{{2,}}|\b[XХ]{{2,}}\b")
ODD_SIGN = re.compile(r"[{}\[\]<>#@$&*_~^\\]|\.\.\.\.|…|[XХ]{2}|%\w|\?\w")
IDENTIFIER = re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b", re.I)


def passages(text: str) -> Iterator[str]:
    for line in BREAK.split(text):
        line = BULLET.sub("", " ".join(line.split()))
        if line:
            yield from SENTENCE.split(line)


def may_have_slot(text: str) -> bool:
    return any(k in text for k in SLOT_SIGNS) or any(k in text and r.search(text) is not None for k, r in RARE_SIGNS)


def is_filler(passage: str) -> bool:
    low = passage.lower()
    if low.startswith("lorem ipsum") or FISH.match(passage):
        return True
    if "lorem ipsum" in low and sum(1 for w in WORD.findall(low) if re.match("[а-яё]", w)) < 3:
        return True
    words = WORD.findall(low)
    every = TOKEN.findall(low)
    if len(every) >= MONOTONE and len(set(every)) * 4 <= len(every) and words:
        return True
    if len(words) >= 2 and sum(bool(SAME.fullmatch(w)) for w in words) * 3 >= len(words) * 2:
        return True
    return len(words) >= 4 and sum(w in MASH for w in words) * 10 >= len(words) * 8


def frames_of(passage: str, spans: list[tuple[int, int]]) -> list[tuple[str, str]]:
    """The two frames of each span: a word before and one after, and two before and one after, up to the next span;
    empty where they hold no word of three letters, or the narrow one lacks a side."""
    out = []
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans[1:]), len(passage)]
    for (a, b), left, right in zip(spans, ends, starts):
        before, after = passage[left:a].lower().split()[-2:], passage[b:right].lower().split()[:1]
        narrow = f"{before[-1]}□{after[0]}" if before and after else ""
        wide = f"{' '.join(before)}□{''.join(after)}"
        out.append(tuple(f if any(len(w) > 2 for w in WORD.findall(f)) else "" for f in (narrow, wide)))
    return out


def read(text: str) -> tuple[bool, bool, bool, list[tuple[str, str, str, str]]]:
    """(residue for certain, residue unless aligned records speak against it, holds an error message,
    [("frame" | "odd", narrow frame, wide frame, residue)])."""
    low = " ".join(text.lower().split())
    can_message = any(k in low for k in MESSAGE_SIGNS)
    rough = text.split(". ")
    lines = text.split("\n")
    can_fill = any(k in low for k in FILLER_SIGNS) or any(len(w) >= MONOTONE and len(set(w)) * 2 <= len(w) for w in map(str.split, BREAK.split(text)))
    repeats = any(y and x.endswith(y) and z.startswith(y) for x, y, z in zip(rough, rough[1:], rough[2:])) or any(x == y == z and x for x, y, z in zip(lines, lines[1:], lines[2:]))
    slots, odd = may_have_slot(text), ODD_SIGN.search(text) is not None
    sure = likely = message = False
    frames: list[tuple[str, str, str, str]] = []
    if not (can_message or can_fill or repeats or slots or odd):
        return False, False, False, frames
    last, times = "", 0
    for p in passages(text):
        times = times + 1 if p == last else 1
        last = p
        if times == 3 and 2 <= len(WORD.findall(p)) <= 12:
            sure = True
        if can_message and MESSAGES.match(p):
            message = True
        elif can_fill and is_filler(p):
            sure = True
        elif slots and may_have_slot(p) and (found := [m.span() for m in SLOT.finditer(p)]):
            for (narrow, wide), (a, b) in zip(frames_of(p, found), found):
                frames.append(("frame", narrow, wide, p[a:b]))
                after = p[b:].split()
                # Alone at the end, or glued before a sentence: nothing speaks of it.
                likely = likely or b == len(p) or (a == 0 and bool(after) and after[0][0].isupper())
            rest = len(WORD.findall(SLOT.sub(" ", p)))
            sure = sure or rest == 0
            likely = likely or rest <= FRAME_WORDS
        elif odd and ODD_SIGN.search(p) and (found := [m.span() for m in ODD.finditer(p)]):
            frames += [("odd", narrow, wide, p[a:b]) for (narrow, wide), (a, b) in zip(frames_of(p, found), found)]
    return sure, likely, message, frames


def is_page(text: str) -> bool:
    """Whether a text with a message is an error page as a whole, however long a stack trace makes it."""
    if len(text) <= PAGE:
        return True
    hits = [MESSAGES.match(p) is not None for p in passages(text)]
    return sum(hits) * 2 >= len(hits)


def evidence(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", pages: bool = False) -> DataFrame:
    """(id, kind, narrow, wide, residue): kind "residue" and "message" are certain, "likely" is decided where no other
    record aligns, "frame" and "odd" are spans to align.  "page" is a text that holds an identifier, as digest of the
    text with digits and identifiers masked beside the digest of the text; "error" is an error page, masked, listed
    where ``pages``."""
    id_kind = df.schema[id_col].dataType.simpleString()
    names = ["kind", "narrow", "wide", "residue"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            cols: list[list] = [[], [], [], []]

            def put(i: int, *values: str | None, row=row, cols=cols) -> None:
                row.append(i)
                for c, v in zip(cols, values):
                    c.append(v)

            for i, text in enumerate(batch.column(1).to_pylist()):
                sure, likely, message, frames = read(text)
                for kind, yes in (("residue", sure), ("message", message), ("likely", likely)):
                    if yes:
                        put(i, kind, None, None, None)
                if IDENTIFIER.search(text):
                    put(i, "page", None, hashlib.md5(MASK.sub("0", text).encode()).hexdigest(), hashlib.md5(text.encode()).hexdigest())
                if pages and message and is_page(text):
                    put(i, "error", None, "\n".join(dict.fromkeys(MASK.sub("0", p) for p in passages(text))), None)
                for kind, narrow, wide, residue in frames:
                    put(i, kind, narrow, wide, residue)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names=[id_col, *names])

    texts = df.where(F.col(text_col).isNotNull() & (F.length(text_col) > 0)).select(id_col, text_col)
    return texts.mapInArrow(run, f"`{id_col}` {id_kind}, " + ", ".join(f"{n} string" for n in names))


def _met(rows: DataFrame, keys: DataFrame, id_col: str, salts: int) -> DataFrame:
    """Rows whose ``k`` is among the distinct ``keys``, by key and salt."""
    copies = keys.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_s", salt(id_col, salts)).join(copies, ["k", "_s"], "left_semi").drop("_s")


def routes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """(id, route) of texts with at least one residue passage, one row for each route that finds it.

    Routes: "aligned" (a seed or code-like span in an induced slot), "page" (a machine-made page that repeats),
    "message", "filler" (nothing but residue or filler in a passage) and "alone" (a seed at the end of a passage or in a
    short one, whose frame no other record has).  All thresholds are shares, so the verdict on a text does not depend on
    the size of the corpus.  Null, empty and blank texts are none.  Repeated rows count once.  One pass over the texts;
    only evidence is shuffled.  Frames are counted by (frame, residue) first, so one that a third of all texts hold is
    reduced map-side; evidence meets its frame's verdict by frame and salt.
    """
    e = stash(evidence(df, id_col, text_col), "evidence")
    spans = e.where("kind in ('frame', 'odd')").withColumn("k", F.explode(F.array(*[F.when(F.col(c) != "", F.xxhash64(F.lit(c), c)) for c in ("narrow", "wide")]))).where("k is not null")
    seeds = spans.where("kind = 'frame'").select(id_col, "k", F.xxhash64("residue").alias("v"))
    each = seeds.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    induced = each.groupBy("k").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where(F.col("most") <= F.col("n") * SAME_SHARE).select("k")
    aligned = _met(spans.select(id_col, "k"), induced, id_col, salts).select(id_col, F.lit("aligned").alias("route"))
    copies = e.where("kind = 'page'").groupBy("wide", "residue").agg(F.count(F.lit(1)).alias("n")).groupBy("wide").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PAGE_COPIES)
    page = _met(e.where("kind = 'page'").select(id_col, F.xxhash64("wide").alias("k")), copies.select(F.xxhash64("wide").alias("k")), id_col, salts).select(id_col, F.lit("page").alias("route"))
    route = F.when(F.col("kind") == "residue", "filler").when(F.col("kind") == "message", "message").otherwise("alone")
    by_itself = e.where("kind in ('residue', 'message', 'likely')").select(id_col, route.alias("route"))
    return aligned.unionByName(page).unionByName(by_itself).distinct()


def found_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The ids of texts with at least one residue passage by any of the ``routes``, one row an id."""
    return routes(df, id_col, text_col, salts).select(id_col).distinct()


def route_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(route, n_docs): the texts found, each by the first of its routes in the order aligned, page, message, filler, alone."""
    order = F.array(*[F.lit(r) for r in ("aligned", "page", "message", "filler", "alone")])
    first = routes(df, id_col, text_col).groupBy(id_col).agg(F.min(F.array_position(order, F.col("route"))).alias("p"))
    return first.groupBy(F.element_at(order, F.col("p").cast("int")).alias("route")).agg(F.count(F.lit(1)).alias("n_docs"))


def page_templates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(page, n_docs): whole-page error templates, with digits and identifiers masked, that repeat over documents."""
    pages = evidence(df, id_col, text_col, pages=True).where("kind = 'error'").select(id_col, F.col("wide").alias("page")).distinct()
    return pages.groupBy("page").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= least)


def without_residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the texts found; rows with a null id or text stay."""
    return df.join(found_residue(df, id_col, text_col), id_col, "left_anti")

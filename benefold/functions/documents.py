"""Requirement lines: items, decorations, canonical names, and whether an item names a document."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import clean_text

# Markers, decorations, hints and canonical names.
LIST_MARKER = r"^[\s]*(?:[・\-*●○◆■]|[（(]?\s*[0-9０-９]{1,2}\s*[）).]|注釈\s*[0-9０-９]+\s*[）)])\s*"
DECORATION = r"(?iu)\s*[（(][^（）()]*(?:PDF|ＰＤＦ|エクセル|Excel|ワード|Word|形式|KB|MB)[^（）()]*[）)]|新しいウィンドウで開きます|別ウィンドウで開きます"
ALIASES = (
    (r"^(?:母子|親子)(?:健康)?手帳", "母子健康手帳"),
    (r"^(?:健康)?保険証|^健康保険被保険者証|^資格確認書", "健康保険証"),
    (r"^(?:こども|子ども|子供)医療[証費]", "こども医療証"),
    (r"^(?:予防接種)?予診票", "予防接種予診票"),
    (r"^(?:個人番号|マイナンバー)(?:カード)?|^マイナンバーカード", "マイナンバーカード"),
    (r"^印鑑|^印章|^はんこ", "印鑑"),
    (r"^本人確認(?:書類|できるもの)", "本人確認書類"),
)
NO_DOCUMENT = r"<[a-zA-Z/]|\||こちら|外部サイト|外部リンク|ください|ます。|です。|注意|お問い合わせ|場合は|場合があります|ご覧|できません|必要です"
NO_START = r"^(?:ダウンロードは|詳しくは|詳細は|くわしくは|ただし|また|なお|その他|および|及び|かつ)"
NO_END = r"[。！？、，]$"
LONGEST = 40


def split_items(c: Column) -> Column:
    """Items of a requirement text: its lines, without list marker, trimmed; blanks are dropped."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(F.regexp_replace(F.replace(x, F.lit("　"), F.lit(" ")), r"(?U)^\s+|\s+$", ""), LIST_MARKER, ""))
    return F.filter(F.transform(lines, clean_text), lambda x: x.isNotNull())


def strip_decorations(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?U)" + DECORATION, ""), r"^[ 　,、]+|[ 　,、]+$", "")


def canonical_name(c: Column) -> Column:
    """The canonical name of a document, or the name without decorations."""
    plain = F.regexp_replace(F.regexp_replace(strip_decorations(c), r"(?U)^\s+|\s+$", ""), r"^[「」『』（）()]+|[「」『』（）()]+$", "")
    return F.coalesce(*(F.when(plain.rlike(p), F.lit(name)) for p, name in ALIASES), F.nullif(plain, F.lit("")), c)


def looks_like_document(c: Column) -> Column:
    """Length and hints are judged without decorations, starts and ends on the raw item."""
    raw = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    text = F.regexp_replace(strip_decorations(raw), r"(?U)^\s+|\s+$", "")
    few = F.length(text) - F.length(F.replace(text, F.lit("、"), F.lit(""))) < 2
    good = (text != "") & (F.length(text) <= LONGEST) & ~raw.rlike(NO_START) & ~raw.rlike(NO_END) & ~text.rlike(NO_DOCUMENT) & few
    return F.coalesce(good, F.lit(False))

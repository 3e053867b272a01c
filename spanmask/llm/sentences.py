"""Sentence units in any script (problem 1).

Every place where a unit could end (after an end mark and its closing quotes, at a line break, at a blank in a
script that writes no end marks) is tagged as boundary or inside by a linear-chain conditional random field with
Viterbi decoding; all other characters are inside.

The field learns from texts with partial labels. Places are labelled where the writing leaves no doubt: an empty line, a
question or exclamation mark or a full stop of a script without abbreviations before a new sentence, a lower-case word
after a period or line break, a comma at a line's end, a quotation inside a sentence. The others, above all periods before
capitals, are latent: their labels are summed out. What can follow which words is told by annotated texts (ANNOTATED).
For scripts without end marks, marks and the blanks between words are stripped from punctuated texts: blanks stay where a
sentence ended (a boundary), at numbers and where a comma stood (no boundary), and the labels are those of the marks removed.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.glyphs import fold, table, visible

#: Texts the field is fitted on, chosen by a hash of the key among those of up to FIT_CHARS characters. Every row is segmented.
FIT_TEXTS, FIT_CHARS = 2400, 5000
#: Places of one text that the fit takes as one chain; longer texts give several chains.
CHAIN = 8
MARKS = ".!?…。！？｡।॥؟۔"
#: Marks that end a sentence wherever they stand: no abbreviation is written with them.
FULL = "。！？｡।॥"
CLOSERS = "\"'”’)]」』）】»"
OPENERS = "\"'“‘(「『（【«„¿¡["
#: Letters of scripts that write no end marks: Thai, Lao, Myanmar, Khmer.
BARE = "฀-๿຀-໿က-႟ក-៿"
# Fixed values, word classes of the features: abbreviations, words that continue a company's name, months.
ABBREVIATIONS = frozenset(
    "rs mr mrs ms dr prof smt shri sri hon no nos fig figs sec secs sch ct attn tel ref cf viz vs approx ca rd abs abb art arts nr sr sra mio mrd al n e.g i.e d.h z.b incl min max p pp c.p w.e.f r.a "
    "ste apt rm st ave ln mn flr bldg engg intl mfg chem fin pwr sys hldgs tech inds infra mg vol ed est bzw ggf usw dra ud uds mme mlle av env रु डॉ क्र श्री कु प्रो د".split()
)
FIRM = frozenset("ltd limited private pvt llp inc sys works dyes co corp holdings".split())
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember january february march may june july october december".split())
#: Annotated texts, every boundary marked by ¦.
ANNOTATED = (
    "Revenue rose.¦ Costs fell in 2019.¦ The board met on Friday.¦ Did the lender agree?¦ No. 5 was withdrawn!¦ Mr. Long of Acme Ltd. paid Rs. 38.71 to him.",
    "The plan was approved on 4 May 2020.¦ Sales grew to 45.¦ It was filed as Nos. 4 and 7 (Fig. 3 and Sec. 9).¦ See Sch. IV, p. 8, Art. 6 and pp. 3.¦ Mrs. Asha Rao, Ms. Kiran Bell and Dr. T. Gorley signed.",
    'The court held: "The claim fails. Costs follow."¦ The firm paid.¦ "Is it fair?" asked the clerk.¦ (See note 4.)¦ The U.S. dollar fell, i.e. by 3 per cent.¦ We sell to the U.K.¦ The plant runs.',
    '"The terms are good," the agent wrote, "and we keep them."¦ "We file on Monday," Mr. Bell wrote to us.¦ The clerk asked, "Who pays for it?"¦ A reply came.¦ "Do you agree?"¦ "We agree."¦ He left.',
    "General Information\nThe registrar sealed the\nbox at 4.15 p.m. on that day.¦\nThe box was opened.¦\n\nAnother heading¦\n\nThe end came.¦ A. B. Long signed it.",
    "Risk Factors¦\nOur sales depend on a few\nBuyers in the north of\nIndia and on the Board.¦\nObjects of the Offer¦\nThe objects are: (i) loans; (ii) plant;\nand (iii) other needs.¦\nDated: 4 May 2020¦\nPlace: Pune",
    "The office of Bell Engg. Works is shut.¦ Long Mfg. Co. Ltd. and Rao Sys. Private Limited merged.¦ Gorley Intl. Pvt. Ltd. was wound up.¦ It deals in rods, wires, etc.¦ The rest is scrap.¦ The bank sits in Washington, D.C.¦ The office is at St. Mary Rd. No. 8.",
    "Costs (in Rs. mn.) were high.¦ The bar, min. 4 and max. 9, approx. 30 hrs. a day, was set.¦ The agent, viz. the bank, cf. ref. AB/20, was heard in Ct. No. 4.¦ Shri Bell and Smt. Rao came.¦ Prof. and Mrs. Bell, Attn. Dr. Hart, Tel. No. 44.",
    "The shop opens at 9 a.m. and closes at 6 p.m.¦ The clerk left.¦ Gross sales, e.g. 2.5x in 1999, are given incl. tax.¦ Interest is 9 per cent p.a. on the sum.¦ The Hon. Judge\nheard C.P. No. 7 of 2011.¦ Why not?!¦ It is over ... and no date is set.¦ We wait...¦ The end.",
    "Dr. R. Bell, M.B.B.S., sits here.¦ The files of Mr. Hart, Ravi K.¦ The agent came.¦ The letter names Long, Asha B.¦ A copy was sent.¦ Mail a.bell @ acme.example or r.bell [at] acme [dot] example now.¦ Read www.acme.example/a.b.v2.pdf first.¦ Build v2.4.18 went live.",
    "The sum is due.¦The firm paid it.¦ It is final.¦Sales rose again.¦ The panel met at noon.¦“We agree,” it said.¦ It was sold to Bell L.L.P.¦ Hart (P) Ltd. paid.¦ M/s Hart Inds. sued.¦ K.E.L. merged with B.R.L. in 2004.¦ Order No. 8 of 04.05.2020 was set aside.",
    "本公司发行新股。¦“价格公平。”¦谁来付款？¦请勿透露！¦金额为30.5元，见第2.4节。¦他说：“账目属实。”¦净利润增长。¦（见附注四。）¦配当は30円とする。¦株式を発行しました。¦「価格は妥当です。」¦彼は「行く。」と言った。¦目論見書をお読みですか？¦ はい。",
    "หุ้นละ 67.40 บาท¦ คณะกรรมการอนุมัติแผนงาน¦ ผู้สอบบัญชีรับรองงบการเงิน¦ กำไรเพิ่มขึ้นร้อยละ 15 จากปีก่อน¦\nโปรดอ่านหนังสือชี้ชวน¦\n\nบริษัทออกหุ้นใหม่¦ ราคาหุ้นละ 15 บาท",
    "ຄະນະກຳມະການອະນຸມັດແຜນການ¦ ກຳໄລເພີ່ມຂຶ້ນ 12 ກີບ¦ ກະລຸນາອ່ານເອກະສານ¦\nក្រុមហ៊ុនចេញភាគហ៊ុនថ្មី¦ តម្លៃ 40 រៀល¦ សូមអានឯកសារ",
    "हे खरे आहे का?¦ रु. 94 इतकी रक्कम जमा केली.¦ कंपनी ने शेयर जारी किए।¦ लाभ बढ़ा।¦ डॉ. राव समिति के सदस्य हैं।¦ श्री. बेल ने हस्ताक्षर किए।¦ क्र. 5 रद्द झाला.¦ सभा झाली.",
    "وافق مجلس الإدارة على الخطة.¦ بلغ السعر 44 ريال للسهم.¦ هل اطلع المستثمر؟¦ لا تشارك الرمز!¦ حصص کی قیمت 40 روپے ہے۔¦ بورڈ نے منصوبہ منظور کیا۔¦ کیا آپ نے پڑھا؟",
    "Der Kurs fiel um 38 Prozent, d. h. auf den Stand.¦ Am 5. März tagte der Rat.¦ Wurde er geprüft?¦ „Wir prüfen das“, sagte der Prüfer.¦ Es kostet z. B. 4 Euro.¦ Herr Bell kam am 12. Juni.¦ Nr. 5 und Abs. 2 gelten.¦ Er kam bzw. ging.¦ Größere Beträge fehlen!",
    "¿Recibió el folleto?¦ El Sr. Long firmó el acta n.º 4.¦ Según el art. 7, vence en 2018.¦ ¡No lo comparta!¦ La Sra. Bell y el Dr. Rao votaron.¦ « Le prix est juste. »¦ Voir l'art. 7.¦ M. Long préside le comité.¦ A-t-il été informé ?¦ Mme Bell a signé.¦ La page 5 suit.",
    "Цена выросла.¦ Совет одобрил план.¦ Кто платит?¦ 株主総会は終了した。¦ 取締役会は承認した。¦ Bell, R. K.¦ Wires and nails¦\n\nSummary of the Offer¦\nShares were issued at par.¦\nFace value",
    "The plant is shut.¦ 4,50,000 shares were sold.¦ 12.5 tonnes were made in the year.¦ The box was sealed at 9 p.m.¦ 30 clerks came.¦ It was set aside in 2019.¦ 7 boxes were left.¦\n8,20,000 shares were issued.¦ The plant runs 300 days a year.¦ 61.3 tonnes were sold.¦ (PAN: ABCPT1234F) is his.",
    "Write to Asha.Bell@acme.example or RAVI+IPO@MAIL.ACME.EXAMPLE now.¦ Mail Kiran.Hart [at] acme [dot] example, T.Gorley (at) acme.example or John.Rao AT acme DOT test.¦ The ticket names ASHA_BELL@ACME.EXAMPLE as the sender.¦ Ravi.Hart@mail.acme.example",
    "Queries may be sent to a.bell@acme.example¦\nThe agent came.¦\nMail asha(at)acme.example¦\nBorn on 4 May 1960, Mr. Hart joined.¦\nSend it to r.k@acme.example¦\nWe deal in rods.¦\nLEGAL AND OTHER INFORMATION¦\nThe issue closed.¦\nKey Personnel¦\nThe agent left.¦\nSummary of Offer¦\n\"We file,\" he said.",
    "Mr. Ravi K. Hart pledged his shares.¦ Asha B. Rao and W. K. Long voted.¦ Ms. T. R. Gorley (PAN: ABCDE1234F) holds 4 shares.¦ It was traced to the account of E. K. Bell.¦ Mrs. G. Hart, Kiran S. Rao and P. Bell left.¦ The letter of Hart, Asha M.¦ (PAN: ABCDE1234F) is here.¦ The trustee is Long, Ravi T.¦ It was filed.",
    "The debentures of Bell Txtls. Private Limited and Hart Txtls. Pvt. Ltd. were paid.¦ Rao Pharma. Ltd. sits in the U.S.¦ Long Log. & Prts. Ltd., Bell Chem. and Dyes Ltd. and Gorley Pwr. Sys. Limited merged.¦ It was sent to M/s Rao Fin. Pvt. Ltd.: Asha Bell, 4 Mary Ave. Pune.¦ The audit of Hart Hldgs. LLP was done.",
    "El Sr. Ravi K. Hart firmó el acta.¦ La Sra. T. Bell votó.¦ M. H Gorley préside.¦ M. A. Bell et Mme R. Hart signent.¦ Herr T. Long kam.¦ Escriba a Asha.Bell@acme.example hoy.¦ Écrivez à Ravi.Hart@acme.example.¦ Die Bank zahlt.¦ 5.000 Aktien wurden verkauft.¦ Se pagó.¦ 300 acciones quedan.",
    "คณะกรรมการอนุมัติแผน¦ บริษัทออกหุ้นใหม่จำนวน 7,20,000 หุ้น ในปี 2563¦ กำไรสุทธิเพิ่มขึ้นร้อยละ 8.5 จากปีก่อน¦ โปรดอ่านหนังสือชี้ชวนก่อนตัดสินใจ¦ คณะกรรมการอนุมัติแผน¦ ผู้สอบบัญชีรับรองงบการเงินแล้ว¦ กรุณาติดต่อ a.bell@acme.example¦ ราคาหุ้นละ 9 บาท",
    "如有疑问，请致函Asha.Bell@acme.example。¦公司于2004年发行了4,50,000股新股。¦連絡先はRavi.Hart@acme.exampleです。¦配当は5.5円とする。¦يرجى مراسلة Asha.Bell@acme.example.¦ وافق المجلس.¦ लिखें asha.bell@acme.example पर।¦ सभा हुई।",
    "Basis for Issue Price¦\nThe nominee is Asha Bell.¦\nObjects of the Issue¦\nRavi Hart voted.¦\nCapital Structure of Bell¦\n4,50,000 shares were sold.¦\nOur Management¦\nDr. R. Bell, the Director of\nHart Limited, signed the\nDeed.¦\nObjects of the Issue¦\nThe firm paid.¦\nBasis for Issue Price¦\nAsha Rao left.",
    "It was sold by Hart Intl. (P) Ltd. and Bell Inds. (P) Ltd. in 2004.¦ Rao Engg. (P) Ltd. merged with M/s Long Hldgs. (P) Ltd. then.¦ Tel. (0484) 276 4468, Attn. (Ms.) Bell.¦ The debentures of Hart Industries, Ltd.¦ For the record, the claim fell.¦ It was carried out by Bell Works Pvt. Ltd.¦ The clerk left.¦ It was sent to Long, Inc.¦ They paid.",
    "บริษัทออกหุ้นใหม่จำนวน 4,50,000 หุ้น¦ ผู้สอบบัญชีรับรองงบการเงิน¦ ซื้อหุ้นจำนวน 3,000 หุ้น ในปี 2563¦ คณะกรรมการอนุมัติแผน¦ จ่ายปันผล 4 บาท ต่อหุ้น¦ ผู้ลงทุนควรอ่านหนังสือชี้ชวน¦ มีหุ้น 90,000 หุ้น¦ คณะกรรมการประชุมกันแล้ว",
    "General Information¦\nKindly reach Asha Bell.¦\nGeneral Information¦\nThe Hon. Tribunal\nheard it.¦\nOther Information¦\n4,50,000 shares were sold.¦ See Sec. 4 of Annexure B,\np. 8, for the terms.¦ ผู้สอบบัญชีรับรองงบการเงิน¦\nUnder entry 4 it was paid.¦\nคณะกรรมการอนุมัติแผน¦\nRef. 4/B.¦\nMail asha AT acme DOT test¦\n4,50,000 shares were sold.¦\nr.b [at] acme [dot] example¦\n(Ticket 4.)",
)
_COMMON = {"of", "the", "for", "and", "to", "in"}
_PLACE = re.compile(
    rf"(?P<mark>[{re.escape(MARKS)}]+)(?P<close>(?:[ \xa0  ]»|[{re.escape(CLOSERS)}])*)(?P<gap>\s*)|(?P<line>[^\S\n]*\n\s*)|(?<=[{BARE}])(?P<bare>[^\S\n]+)(?=[{BARE}])"
)
_LEFT, _RIGHT = re.compile(r"[^\s'’]*\Z"), re.compile(r"\S{0,24}")
_MAIL = re.compile(r"@|\[at\]|\(at\)|\bAT\b|\[dot\]|\(dot\)|\bDOT\b")
_AHEAD = re.compile(r"\S*(?:\s?@|\(at\)|\s?\[at\]|\sAT\s)|[\w.-]*\s?[\[(]dot[\])]")
_REVERSED = re.compile(r"[A-Z][^\W\d_]+, [A-Z][^\W\d_]+ [A-Z]\Z")
_OPEN = re.compile(r"[\"“„«「『(（\[]")
_BARE_CHAR = re.compile(f"[{BARE}]")
INVISIBLE = "​"


def _one_to_one() -> dict[int, str]:
    """Of the look-alike table, one character for each, so that places stay; invisible ones become U+200B."""
    return {ord(c): INVISIBLE if not f else c if unicodedata.combining(f[-1]) else f[0] for c, f in table().items() if c not in "\n\r\t"}


_SHADOW: dict[int, str] = {}


def shadow(text: str) -> str:
    if text.isascii():
        return text
    if not _SHADOW:
        keep = set(map(ord, MARKS + CLOSERS + OPENERS + "…"))
        _SHADOW.update({c: f for c, f in _one_to_one().items() if c not in keep})
    return text.translate(_SHADOW)


def _kind(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if c in OPENERS:
        return "open"
    return "letter" if c.isalpha() else "other"


class Place:
    """A place where a unit could end: the left unit's end, the right unit's start, and what's around it."""

    __slots__ = ("bare", "close", "digits", "gap", "left", "length", "mail", "mark", "quoted", "reversed", "right", "right_kind", "start", "stop", "title")


_BLANKS = " \t\xa0\u2009\u202f" + INVISIBLE
_PAIRS = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_QUOTE = re.compile(r"[\"“”„«»「」『』()（）\[\]\n]")


def _spans_inside(s: str) -> list[tuple[int, int]]:
    """Stretches between quotes or brackets that open in mid-sentence, in order of their ends."""
    out, stack = [], []
    for m in _QUOTE.finditer(s):
        c, at = m[0], m.start()
        if c == "\n":
            if s[at + 1 : at + 2] == "\n":
                stack.clear()
        elif stack and c == stack[-1][0]:
            _, begin, mid = stack.pop()
            if mid:
                out.append((begin, at))
        elif c == '"' or c in _PAIRS:
            k = at
            while k and s[k - 1] in _BLANKS:
                k -= 1
            stack.append((_PAIRS.get(c, '"'), at, bool(k) and s[k - 1] not in MARKS + "\n" + CLOSERS))
    return out


def places(text: str) -> list[Place]:
    """The places of a text, in order; its quotes and brackets are looked at once, so time grows with the text only."""
    s = shadow(text)
    out: list[Place] = []
    inside: list[tuple[int, int]] | None = None
    events: list[tuple[int, int]] = []
    depth = seen = 0
    quotes: list[int] | None = None
    last = 0
    for m in _PLACE.finditer(s):
        p = Place()
        mark, line = m["mark"], m["line"]
        p.mark, p.close, p.gap = mark or "", m["close"] or "", m["gap"] if mark else line or m["bare"]
        p.start = m.start("gap") if mark else m.start()
        p.stop = m.end()
        if p.close and '"' in p.close:
            if quotes is None:
                quotes = [i for i, c in enumerate(s) if c == '"']
            if bisect_left(quotes, m.start("close")) % 2 == 0:  # the quote opens
                at = p.close.index('"')
                p.start, p.gap, p.stop = m.start("close") + at, "", m.start("close") + at
                p.close = p.close[:at]
        if p.stop >= len(s):
            continue
        token = _LEFT.search(s, max(0, m.start() - 40), m.start())[0]
        p.left = token.replace(INVISIBLE, "").lstrip(OPENERS)
        right = _RIGHT.match(s, p.stop)[0].replace(INVISIBLE, "")
        p.right = right
        p.right_kind = _kind(right[:1])
        p.bare = bool(m["bare"]) or bool(not mark and _BARE_CHAR.match(s[p.start - 1 : p.start] or " "))
        p.digits = s[p.start - 1 : p.start].isdigit() or right[:1].isdigit()
        if mark and not p.gap:
            p.mail = "@" in token or "/" in token or "www" in token or "(at)" in token or bool(_AHEAD.match(s, p.stop))
        else:
            p.mail = bool(_MAIL.search(s, max(0, m.start() - 50), m.start())) if "\n" in p.gap and not mark else False
        if inside is None:
            inside = _spans_inside(s) if _OPEN.search(s) else []
            events = sorted([(a + 1, 1) for a, _ in inside] + [(b, -1) for _, b in inside])
        while seen < len(events) and events[seen][0] <= p.start - 1:
            depth += events[seen][1]
            seen += 1
        p.quoted = depth > 0
        p.reversed = mark == "." and len(p.left) == 1 and bool(_REVERSED.search(s, max(0, m.start() - 60), m.start()))
        head = s[s.rfind("\n", 0, p.start) + 1 : p.start].split() if "\n" in p.gap else []
        p.title = bool(head) and len(head) <= 8 and all(w[:1].isupper() or w.lower() in _COMMON for w in head)
        p.length = p.start - last
        last = p.stop
        out.append(p)
    return out


def certain(p: Place) -> int | None:
    """1 boundary, 0 inside, where the writing leaves no doubt; else None."""
    if p.gap.count("\n") > 1:
        return 1
    if p.quoted:
        return 0
    if not p.mark:
        if "\n" in p.gap and not p.bare and (p.right_kind == "lower" or p.left.endswith((",", ";"))):
            return 0
        return None
    if p.mark[-1] in FULL:
        return 1
    if p.gap and p.right_kind == "lower":
        return 0
    if p.mark[-1] in "?!؟۔" and p.gap and p.right_kind in ("upper", "letter"):
        return 1
    if p.mark == "." and not p.gap and p.right_kind in ("lower", "digit", "other"):
        return 0
    return None


def _shape(token: str) -> str:
    """Of a token's first two characters and its make: A capital, a small, 0 digit, x letter without case."""
    if not token:
        return ""
    one = lambda c: "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "x" if c.isalpha() else c
    return one(token[0]) + (one(token[1]) if len(token) > 1 else "_")


def features(p: Place) -> list[str]:
    """What the field knows of a place: its mark and gap, the words beside it, their shapes and word classes, and quotes."""
    left, right = re.sub(r"\d", "0", p.left.lower()), re.sub(r"\d", "0", p.right.lower())
    gap = "nn" if p.gap.count("\n") > 1 else "n" if "\n" in p.gap else "s" if p.gap else "0"
    mark = "full" if p.mark and p.mark[-1] in FULL else p.mark[:2]
    base = f"{mark}{gap}"
    tail = left.rsplit("(", 1)[-1].rsplit("/", 1)[-1]
    word = right.rstrip(".,;:)\"'”’")
    known = "abbr" if tail in ABBREVIATIONS else "one" if len(left) == 1 and left.isalpha() else "dots" if "." in left.strip(".") else ""
    ahead = "firm" if word in FIRM or word.startswith("(p)") else "month" if word in MONTHS else ""
    shape, next_ = f"{_shape(p.left)}{min(len(left), 4)}{left[-1:] if left[-1:] in ',;:-' else ''}", _shape(p.right)
    out = ["bias", f"m={base}", f"k={base}{p.right_kind}", f"q={p.quoted}{gap}", f"c={base}{bool(p.close)}{p.right_kind}", f"L={left[-12:]}|{mark}", f"l={left[-3:]}|{base}", f"R={word[:12]}|{base}", f"S={shape}|{base}", f"N={next_}|{base}", f"a={known}|{mark}", f"f={ahead}|{mark}|{known}|{shape[:1]}"]
    if p.mark and p.mark[-1] not in FULL:
        out += [f"aN={known}|{base}|{next_}", f"ak={known}|{base}|{p.right_kind}", f"SN={shape}|{next_}|{base}", f"rev={p.reversed}|{next_[:1]}", f"mail={p.mail}|{base}|{next_[:1]}", f"ma={p.mail}|{gap}"]
    elif not p.mark:
        out += [f"bare={p.bare}|{p.digits}|{gap}", f"len={p.bare}|{min(p.length // 6, 12)}|{p.digits}", f"rl={p.bare}|{min(len(right) // 4, 6)}|{p.digits}", f"t={p.title}|{next_}|{gap}", f"mail={p.mail}|{gap}"]
    return out


def annotated(marked: str) -> tuple[str, set[int]]:
    """The text without its ¦, and where they stood."""
    parts = marked.split("¦")
    at = np.cumsum([len(x) for x in parts[:-1]]).tolist()
    return "".join(parts), set(at)


def stripped(text: str, labels: list[int | None], ps: list[Place]) -> tuple[str, list[int | None]] | None:
    """A text as a script without end marks would write it, and the labels of its places; None where no mark between sentences goes.

    End marks go, words are written together, blanks stay at numbers, where a comma stood and where the marks ended a sentence;
    letters become letters of such a script. Line breaks stay as they are. A place of the new text has the label of
    the mark removed there; at a comma or a number it is no boundary.
    """
    gone = [(p, y) for p, y in zip(ps, labels) if p.mark and p.gap and "\n" not in p.gap]
    if not any(y == 1 for _, y in gone) or any(y is None for _, y in gone):
        return None
    ends = {p.start - len(p.mark) - len(p.close): (p, y) for p, y in gone}
    out: list[str] = []
    marks: dict[int, int] = {}  # places in the new text with their labels
    at = size = 0

    def put(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    while at < len(text):
        c = text[at]
        if at in ends:
            p, y = ends[at]
            if y:
                marks[size] = 1
                put(" ")
                at = p.stop
                continue
        if c in MARKS + "\"'“”‘’":
            at += 1
        elif c == "," and text[at + 1 : at + 2] == " ":
            marks[size] = 0
            put(" ")
            at += 2
        elif c == " ":
            digit = text[at - 1 : at].isdigit() or text[at + 1 : at + 2].isdigit()
            if digit:
                marks[size] = 0
                put(" ")
            at += 1
        else:
            put("ก" if c.isalpha() else c)
            at += 1
    new = "".join(out)
    return new, [marks.get(p.start) if "\n" not in p.gap else certain(p) for p in places(new)]


class Field:
    """A linear-chain conditional random field over the places of a text: labels 0 inside, 1 boundary."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.steps = np.zeros((2, 2))

    def fit(self, texts: list[str], penalty: float = 2e-5, rounds: int = 160) -> "Field":
        """Maximum likelihood of partial labels: latent places are summed out. ``texts`` are joined by the annotated ones."""
        seqs: list[tuple[list[list[str]], list[int]]] = []
        share: list[float] = []

        def add(ps: list[Place], labels: list[int | None], weight: float) -> None:
            for at in range(0, len(ps), CHAIN):
                if any(y is not None for y in labels[at : at + CHAIN]):
                    seqs.append(([features(p) for p in ps[at : at + CHAIN]], [-1 if y is None else y for y in labels[at : at + CHAIN]]))
                    share.append(weight)

        weight = max(1.0, len(texts) / 60)
        for marked in ANNOTATED:
            text, cuts = annotated(marked)
            ps = places(text)
            labels: list[int | None] = [int(p.start in cuts) for p in ps]
            add(ps, labels, weight)
            if (bare := stripped(text, labels, ps)) is not None:
                add(places(bare[0]), bare[1], weight / 2)
        for t in texts:
            ps = places(t)
            labels = [certain(p) for p in ps]
            add(ps, labels, 1.0)
            if not t.isascii() and (bare := stripped(t, labels, ps)) is not None:
                add(places(bare[0]), bare[1], 0.5)
        seen = Counter()
        for (fs, _), n in zip(seqs, share):
            for f in {x for y in fs for x in y}:
                seen[f] += min(n, 3)
        index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
        size = max(len(y) for _, y in seqs)
        ids = [[[index[f] for f in fs if f in index] for fs in x] for x, _ in seqs]
        rows = np.concatenate([np.full(len(f), at) for at, f in enumerate(f for x in ids for f in x)]).astype(np.int64)
        cols = np.array([c for x in ids for f in x for c in f], np.int64)
        lens = np.array([len(y) for _, y in seqs])
        mask = np.arange(size)[None, :] < lens[:, None]
        gold = np.full((len(seqs), size), -1, np.int64)
        gold[mask] = [v for _, y in seqs for v in y]
        much = np.repeat(np.array(share), lens)
        each = np.array(share)[:, None, None, None]
        # What a given label forbids; a latent place forbids nothing.
        bar = np.where(gold == 1, 30.0, 0.0) - np.where(gold == 0, 30.0, 0.0)
        w, steps = np.zeros(len(index)), np.zeros((2, 2))
        state = [np.zeros(len(index)), np.zeros(len(index)), np.zeros((2, 2)), np.zeros((2, 2))]
        both = mask[:, 1:]
        total = much.sum()

        def believed(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = self._messages(u, mask, steps)
            z = a + b
            p1 = 1 / (1 + np.exp(np.clip(z[..., 0] - z[..., 1], -50, 50)))
            e = a[:, :-1, :, None] + steps + np.stack([np.zeros_like(u), u], -1)[:, 1:, None, :] + b[:, 1:, None, :]
            e = np.exp(e - e.max(axis=(2, 3), keepdims=True))
            e = e / e.sum(axis=(2, 3), keepdims=True) * each
            return p1, e[both].sum(axis=0)

        for t in range(1, rounds + 1):
            u = np.zeros((len(seqs), size))
            u[mask] = np.bincount(rows, weights=w[cols], minlength=len(much))
            p_free, e_free = believed(u)
            p_told, e_told = believed(u + bar)
            g = np.bincount(cols, weights=((p_free - p_told)[mask] * much)[rows], minlength=len(w)) / total + penalty * w
            gs = (e_free - e_told) / total + penalty * steps
            for x, grad, m, v in ((w, g, state[0], state[1]), (steps, gs, state[2], state[3])):
                m *= 0.9
                m += 0.1 * grad
                v *= 0.999
                v += 0.001 * grad * grad
                x -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        self.weights, self.steps = {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-4}, steps
        return self

    def save(self, path: str) -> None:
        """As one JSON file; ``load`` reads it, so that many tables are segmented without another fit."""
        with open(path, "w", encoding="utf-8") as out:
            json.dump({"weights": self.weights, "steps": self.steps.tolist()}, out, ensure_ascii=False)

    @classmethod
    def load(cls, path: str) -> "Field":
        out = cls()
        with open(path, encoding="utf-8") as stored:
            got = json.load(stored)
        out.weights, out.steps = got["weights"], np.array(got["steps"])
        return out

    @staticmethod
    def _messages(u: np.ndarray, mask: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        unary = np.stack([np.zeros_like(u), u], -1)
        n = u.shape[1]
        a, b = np.zeros((*u.shape, 2)), np.zeros((*u.shape, 2))
        a[:, 0] = unary[:, 0]
        for i in range(1, n):
            a[:, i] = np.logaddexp(a[:, i - 1, 0:1] + steps[0], a[:, i - 1, 1:2] + steps[1]) + unary[:, i]
        for i in range(n - 2, -1, -1):
            nxt = unary[:, i + 1] + b[:, i + 1]
            b[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(steps[:, 0] + nxt[:, 0:1], steps[:, 1] + nxt[:, 1:2]), 0)
        return a, b

    def decode(self, ps: list[Place]) -> list[bool]:
        """Viterbi: the best labels of all places of a text together."""
        get = self.weights.get
        (s00, s01), (s10, s11) = self.steps.tolist()
        v0 = v1 = 0.0
        back = []
        for i, p in enumerate(ps):
            u = sum(get(f, 0.0) for f in features(p))
            if i:
                f0, f1 = v1 + s10 > v0 + s00, v1 + s11 > v0 + s01
                back.append((f0, f1))
                v0, v1 = max(v0 + s00, v1 + s10), max(v0 + s01, v1 + s11) + u
            else:
                v1 = u
        tag = v1 > v0
        out = [tag]
        for f0, f1 in reversed(back):
            tag = f1 if tag else f0
            out.append(tag)
        return out[::-1]

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """The places (start, end) of a text's units, in order, without outer blanks."""
        if not text or not text.strip():
            return []
        ps = places(text)
        cuts = [(p.start, p.stop) for p, b in zip(ps, self.decode(ps)) if b] if ps else []
        out, at = [], 0
        for a, b in [*cuts, (len(text), len(text))]:
            piece = text[at:a]
            body = piece.strip()
            if body and (len(body) > 1 or body != INVISIBLE):
                begin = at + len(piece) - len(piece.lstrip())
                out.append((begin, begin + len(body)))
            at = b
        return out


def fit(df: DataFrame, key: str, text: str) -> Field:
    """A field of at most FIT_TEXTS of the texts, by a hash of their keys; with none at all, of the annotated ones.

    The rows are counted without reading them, so that only about three times as many texts as are wanted leave the scan.
    """
    share = min(1.0, 3 * FIT_TEXTS / max(1, df.count()))
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(F.expr(f"(xxhash64(_k) & 1048575) < {int(share * 1048576)}"))
    some = texts.where(visible(F.col("_t")) & (F.length("_t") <= FIT_CHARS)).orderBy(F.xxhash64("_k", F.lit(1)), "_k").limit(FIT_TEXTS)
    return Field().fit(sorted({r["_t"] for r in some.select("_t").collect()}))


def units(df: DataFrame, key: str, text: str, field: Field | None = None) -> DataFrame:
    """(key, sent_start, sent_end): a row for each unit of each distinct ``key``, with code-point places in ``text``.

    Null, empty and blank texts have no units; repeated rows (same key) count once; the longest texts are read
    whole; columns besides the two aren't read. Without a given ``field`` one is fitted on at most FIT_TEXTS of the texts.
    """
    field = field or fit(df, key, text)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(pdf["_k"], pdf["_t"]):
                for a, b in field.units(t):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pd.DataFrame({"_k": keys, "_a": starts, "_b": ends})

    one = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(visible(F.col("_t"))).dropDuplicates(["_k"])
    return one.mapInPandas(run, f"_k {kind}, _a int, _b int").select(F.col("_k").alias(key), F.col("_a").alias("sent_start"), F.col("_b").alias("sent_end"))

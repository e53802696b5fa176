"""Minimum-cost syntax repair of source files.

A file becomes a string of token classes, one character a token. The grammars have regular right parts: a
bracketed group is a nonterminal whose right part is a regular expression over token classes and inner groups.
The chart is filled bottom-up over groups. A span that its right part accepts costs nothing; for any other the
cheapest edits (insert, delete or replace a token) are found by dynamic programming over the automaton of the
same expression, whatever the span's length, and traced back to where they lie; brackets that don't match are
repaired by a chart over what is left of them. A file whose cost isn't zero doesn't parse, and the places of the
edits tell truncation, merge conflicts and files of another language apart.

Equal spans are looked up, not parsed again, so a corpus costs little more than its lexing.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
import re._parser as sre
import tempfile
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamdex.llm.provenance import extension
from loamdex.sources.files import assemble

LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "java": "java", "c": "c", "json": "json"}

_DQ, _SQ = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
_BT = r"`(?:[^`\\]|\\.)*`"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bBoO][\d_]+|\d[\d_]*\.?[\d_]*(?:[eE][+-]?\d+)?|\.\d[\d_]*(?:[eE][+-]?\d+)?)[A-Za-z]*"
_ID = r"[^\W\d]\w*"
_COM = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|/\*"
_JSRE = r"(?:(?<=[=(,:\[!&|?{};])|(?<=[=(,:\[!&|?{};>] )|(?<=[^+]\+ )|(?<=return )|(?<=typeof )|(?<=case )|(?m:^)[ \t]+)/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"


def _template(levels: int = 3) -> str:
    """Template strings whose fields may hold strings and templates, nested ``levels`` deep."""
    inner = r"`(?:[^`\\$]|\\.|\$(?!\{))*+`"
    for _ in range(levels):
        piece = rf"[^{{}}`\"']|{_DQ}|{_SQ}|{inner}"
        group = rf"\{{(?:{piece}|\{{(?:{piece}|\{{[^{{}}]*+\}})*+\}})*+\}}"
        inner = rf"`(?:[^`\\$]|\\.|\$(?!\{{)|\$\{{(?:{piece}|{group})*+\}})*+`"
    return rf"{inner}|{_BT}"


_OPS = r">>>=|\.\.\.|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|->|::|:=|<-|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|[-+*/%&|^=!<]=|<<|\*\*|&\^=?|//|[^\s]"



def _fstring(levels: int = 2) -> str:
    """Formatted strings whose fields may hold strings of the same quotes, nested ``levels`` deep."""
    plain = rf"[rbuRBU]{{0,2}}(?:{_DQ}|{_SQ})"
    inner = plain
    for _ in range(levels):
        field_ = rf"\{{(?:[^{{}}'\"\n]|{inner}|\{{(?:[^{{}}'\"\n]|{inner})*\}})*\}}"
        one = "|".join(rf"[rR]?[fF][rR]?{q}(?:[^{q}\\\n{{}}]|\\.|\{{\{{|\}}\}}|{field_})*{q}" for q in "\"'")
        inner = f"{one}|{plain}"
    return one


_LEX = {
    "js": re.compile(rf"\A\#![^\n]*|{_COM}|{_JSRE}|{_DQ}|{_SQ}|{_template()}|{_NUM}|\#?[\w$]+|\n|{_OPS}"),
    "go": re.compile(rf"{_COM}|{_DQ}|{_SQ}|{_BT}|{_NUM}|{_ID}|\n|{_OPS}"),
    "java": re.compile(rf'{_COM}|"""(?:[^\\]|\\.)*?"""|{_DQ}|{_SQ}|{_NUM}|[\w$]+|{_OPS}', re.S),
    "c": re.compile(rf"{_COM}|(?m:^)[ \t]*\#[^\n]*(?:(?<=\\)\n[^\n]*)*|L?{_DQ}|L?{_SQ}|{_NUM}|{_ID}|{_OPS}"),
    "py": re.compile(
        rf"\#[^\n]*|\\\n|[rbfuRBFU]{{0,2}}(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?''')|{_fstring()}|[rbfuRBFU]{{0,2}}(?:{_DQ}|{_SQ})|{_NUM}|{_ID}|\n[ \t]*|\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|[-+*/%@&|^=!<>]=|<<|>>|[^\s]",
        re.S,
    ),
}
_LEX["ts"] = _LEX["js"]
_LEX["json"] = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[A-Za-z_]\w*|[^\s]')

_MARKS = {
    **{c: c for c in "()[]{};,.:?"},
    **dict.fromkeys(("=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>>=", ">>=", "**=", "&&=", "||=", "??=", "&^="), "="),
    "+": "+", "-": "+", "*": "*", "&": "&", "|": "|", "<": "<", ">": ">", "!": "!", "~": "!", "++": "p", "--": "p", "=>": "a", "->": ".", "::": ".",
    "?.": ".", "...": "d", ":=": "w", "<-": "h", "@": "@", "\n": "\n",
    **dict.fromkeys(("/", "%", "^", "&&", "||", "==", "!=", "===", "!==", "<=", "<<", "??", "**", "&^"), "b"),
}
_WORDS = {
    "js": {
        "V": "const let var", "f": "function", "c": "class", "I": "if", "e": "else", "F": "for", "W": "while with", "D": "do", "S": "switch", "k": "case", "q": "default",
        "R": "return throw", "J": "break continue debugger", "t": "try", "g": "catch", "l": "finally", "M": "import", "Z": "export", "m": "from",
        "u": "new typeof void delete await yield", "o": "in instanceof of", "x": "extends", "y": "async", "z": "static get set",
    },
    "go": {
        "f": "func", "I": "if", "e": "else", "F": "for", "S": "switch select", "k": "case", "q": "default", "R": "return", "J": "break continue fallthrough goto", "M": "import",
        "Z": "package", "V": "var const", "T": "type", "C": "struct interface", "m": "map", "H": "chan", "G": "go defer", "r": "range",
    },
    "java": {
        "c": "class interface enum record", "I": "if", "e": "else", "F": "for", "W": "while synchronized", "D": "do", "S": "switch", "k": "case", "q": "default", "R": "return throw assert yield",
        "J": "break continue", "t": "try", "g": "catch", "l": "finally", "M": "import package", "u": "new", "o": "instanceof", "x": "extends implements throws permits",
        "z": "public private protected static final abstract synchronized_ native transient volatile strictfp sealed", "Y": "int long short byte char float double boolean void var",
    },
    "c": {
        "I": "if", "e": "else", "F": "for", "W": "while", "D": "do", "S": "switch", "k": "case", "q": "default", "R": "return", "J": "break continue", "G": "goto", "T": "typedef",
        "C": "struct union enum", "A": "__attribute__ __declspec _Alignas alignas", "z": "static const extern inline volatile register restrict unsigned signed auto", "Y": "int long short char float double void bool _Bool", "u": "sizeof",
    },
    "py": {
        "I": "if", "e": "else", "E": "elif", "F": "for", "W": "while", "D": "def", "c": "class", "R": "return", "r": "raise", "J": "pass break continue", "t": "try", "g": "except", "l": "finally",
        "M": "import", "m": "from", "A": "as", "w": "with", "y": "async", "u": "not", "v": "await", "o": "in and or is", "L": "lambda", "Y": "yield", "G": "global nonlocal", "x": "del", "a": "assert",
    },
}
_WORDS["json"] = {"l": "true false null NaN Infinity"}
_WORDS["ts"] = {**_WORDS["js"], "K": "interface namespace", "T": "type", "E": "enum", "A": "as satisfies", "x": "extends implements", "z": "static get set public private protected readonly abstract declare override", "Q": "keyof infer unique"}


class Classes(dict):
    """Token -> class character; anything not listed is a name, number, string, comment (empty) or error (X)."""

    def __init__(self, lang: str):
        super().__init__()
        self.lang = lang
        self.fixed = dict(_MARKS) if lang != "json" else {c: c for c in "[]{},:"}
        for ch, words in _WORDS[lang].items():
            self.fixed.update(dict.fromkeys(words.split(), ch))
        if lang == "java":
            self.fixed["->"] = "a"
        if lang == "py":
            self.fixed.update({"->": "a", ":=": "h", "**": "*", "//": "b", "@": "@", "!": "X", "?": "X", ";": ";", "|": "b", "&": "b", "<": "b", ">": "b", ">=": "b", "<<": "b", ">>": "b", "//=": "=", "@=": "=", "~": "!", "...": "n", "++": "X"})
        elif lang == "c":
            self.fixed.update({"@": "X", "`": "X", "**": "**"})
        elif lang == "go":
            self.fixed["**"] = "**"
        self.update(self.fixed)

    def __missing__(self, t: str) -> str:
        c = t[0]
        if self.lang == "json":
            v = "s" if c == '"' and len(t) > 1 else "n" if c.isdigit() or c == "-" and len(t) > 1 else "X"
        elif c.isalpha() or c in "_$":
            v = "s" if t[-1] in "\"'" and len(t) > 1 else "i"
        elif self.lang in ("js", "ts") and c in "# \t" and len(t) > 1:
            v = "" if t.startswith("#!") else "i" if c == "#" else "s"  # a private name, a regular expression at the start of a line
        elif c.isdigit() or c == "." and len(t) > 1:
            v = "n" if not self.lang == "py" or re.fullmatch(r"(?:0[xXbBoO][\da-fA-F_]+|[\d_.]+(?:[eE][+-]?\d+)?)[jJ]?", t) else "X"
        elif c in "\"'`":
            v = "s" if len(t) > 1 else "X"
        elif c == "#" and self.lang in ("py", "c") or c in " \t" and self.lang == "c" or t.startswith("//") or t.startswith("/*") and len(t) > 2 or t == "\\\n":
            v = ""
        elif c == "/" and len(t) > 2:
            v = "s"  # a regular expression
        else:
            v = "X"
        if len(t) < 40:
            if len(self) > 300_000:
                self.clear()
                self.update(self.fixed)
            self[t] = v
        return v


def _grammar(lang: str) -> dict[str, str]:
    """Right parts by nonterminal: P and Q are groups in () and [], B, O and C groups in {} that are a block, a
    literal and a body of members; ``file`` is the start. Python's indented blocks are B too."""
    if lang == "json":
        v = "[snlQO]"
        return {"Q": rf"(?:{v}(?:,{v})*)?", "O": rf"(?:s:{v}(?:,s:{v})*)?", "file": v}
    if lang == "py":
        prim = r"(?:s+|[inPQO])(?:\.i|P|Q)*"
        opd = rf"(?:[u+!v])*(?:(?:L(?:\*?i(?:=[ins])?,?)*:)(?:[u+!v])*)?{prim}"
        op = r"(?:uo|ou|o|b|[+*@]|b=)"
        e = rf"(?>{opd}(?:{op}{opd}|I{opd}(?:{op}{opd})*e{opd})*)"
        ne = rf"(?:ih)?{e}"
        star = rf"(?:\*|ih)?{e}"
        es = rf"(?>\*?{opd}(?:(?:{op}|,\*?){opd}|I{opd}(?:{op}{opd})*e{opd})*,?)"
        comp = rf"(?:y?F{opd}(?:,{opd})*,?o{e}(?:I{ne})*)+"
        item = rf"(?:\*?i(?::\*?{e})?(?:[=h](?:{e}|Y)(?:{comp})?)?|\*?{e}(?:={e})?(?:{comp})?|\*|b)"
        small = rf"(?:{es}(?::{e})?(?:=(?:Y?m?(?:{es})|Y))*|R(?:{es})?|r(?:{e}(?:m{e})?)?|J|M(?:i(?:\.i)*(?:Ai)?)(?:,i(?:\.i)*(?:Ai)?)*|m[.n]*(?:i(?:\.i)*)?M(?:\*|P|i(?:Ai)?(?:,i(?:Ai)?)*)|Gi(?:,i)*|x{es}|a{e}(?:,{e})?|Ym?(?:{es})?)"
        line = rf"{small};+"
        body = ":B"
        stmt = (
            rf"(?:I{ne}{body}(?:E{ne}{body})*(?:e{body})?|W{ne}{body}(?:e{body})?|y?F{opd}(?:,{opd})*,?o{es}{body}(?:e{body})?|t{body}(?:(?:g\*?(?:{e}(?:,{e})*(?:Ai)?)?{body})+(?:e{body})?(?:l{body})?|l{body})"
            rf"|(?:@{e};)*(?:y?DiQ?P(?:a{e})?{body}|ciQ?P?{body})|y?w(?:{e}(?:A{opd})?)(?:,{e}(?:A{opd})?)*{body}|i{es}(?:A{opd})?(?:I{ne})?:B|{line})"
        )
        return {
            "P": rf"(?:{item}(?:,{item})*,?|{es}|i(?:Ai)?(?:,i(?:Ai)?)*,?|Y(?:{es})?)?", "Q": rf"(?:(?:{star}(?:{comp})?|(?:{e})?(?::(?:{e})?)+)(?:,(?:{e}|(?:{e})?(?::(?:{e})?)+|\*{e}))*,?)?",
            "O": rf"(?:(?:{e}:{e}|\*{e})(?:{comp}|(?:,(?:{e}:{e}|\*{e}))*,?)|{star}(?:{comp})|{es})?", "B": rf"(?:{stmt})++", "file": rf";*(?:{stmt})*+",
        }
    if lang in ("js", "ts"):
        ts = lang == "ts"
        name = r"[iymozqTKAQE]" if ts else r"[iymozq]"
        var = r"[iymzTA]" if ts else r"[iymz]"
        word = r"[a-zA-Z]"
        if ts:
            inside = r"[iymzTAsnuBOCPQVE.|&,?ax:=+]*"
            gen = rf"(?:<{inside}(?:<{inside}(?:<{inside}>)?{inside}>{inside})*>)"
            t1 = rf"(?:[uz]*(?:{gen})?Pa)*(?:[uQz])*(?:{var}(?:\.{name})*(?:{gen})?|\+?n|[suBOCQP])Q*"
            t = rf"(?:[|&]?{t1}(?:[|&]{t1})*)"
            ann, cast = rf"(?:!?:(?:i?ii(?=[iuBOCQPs])|i(?=i))?{t})?", rf"(?:A(?:V|{t}))*"
        else:
            t, gen, ann, cast = "", "(?:i{0})", "", ""
        genq = rf"{gen}?" if ts else ""
        post = rf"(?:\.{word}|\.?P|\.?Q|s|p{'|!' if ts else ''}{f'|{gen}(?=P)' if ts else ''})*"
        fn = rf"y?f\*?{name}?{genq}P{ann}B"
        cls = rf"c{name}?{genq}(?:x(?:{name}|P)(?:\.{name}|P|{gen if ts else 'P'})*(?:,{name}(?:\.{name})*{genq})*)*[CBO]" if ts else rf"c{name}?(?:x(?:{name}|P)(?:\.{name}|P)*)?[CBO]"
        arrow = rf"(?:y?(?:{name}|{genq}P{ann})a)*"
        pre = rf"[+!p]|u\*?|{gen}(?=[insPQBu])" if ts else r"[+!p]|u\*?"
        opd = rf"{arrow}(?:{pre})*(?:y?f\*?{name}?{genq}P{ann}B|{cls}|[nsPQBO]|{name}|M)(?:{post}){cast}"
        op = r"(?:b|[+*&|o=]|b=|<+|>+=?)"
        mid = rf"{opd}(?:{op}{opd}|\?{opd}(?:{op}{opd})*:{opd})*"
        e = rf"(?>{opd}(?:{op}{opd}|\?{mid}:{opd})*)"
        es = rf"(?>{opd}(?:(?:{op}|,){opd}|\?{mid}:{opd})*)"
        e1 = rf"(?>{opd}(?:{op}{opd})*)"
        decl = rf"V(?:(?:{name}|[QBO]){ann}(?:={e})?(?:,(?![;)])|(?=[;)]|$)))+"
        param = rf"z*d?(?:{name}|[QBO])\??{ann}(?:={e1})?" if ts else rf"d?(?:{name}|[QBO])(?:={e1})?"
        forhead = rf"(?:V?(?:{name}|[QBO])(?:o|{ann}o){es}|(?:{decl}|{es})?(?:;(?:{es})?){{2}})"
        names = rf"{word}(?:[Ai]{word})?"
        spec = rf"(?:{word}(?:[iA]{word})?)(?:,{word}(?:[iA]{word})?)*,?"
        key = rf"(?:{word}|s|n|Q)"
        member = rf"(?:z|y)*\*?(?:{key})[?!]?{genq}(?:P{ann}(?:B|;)?|{ann}(?:={e})?[;,]?)" if ts else rf"(?:z|y)*\*?(?:{key})(?:P[B]|(?:={e})?;)"
        prop = rf"(?:{key}:{e}|(?:z|y)*\*?{key}{genq}P{ann}B|{name}(?:={e})?|d{e})"
        head = r"(?:IP|Fu?P|FP|WP)"
        simple = rf"(?:;|{decl};|(?:R(?:{es})?|J{name}?|{es})(?:;|(?=e))|DBWP;?|D(?:{es});WP;?)"
        imp = rf"(?:M(?:{genq}s|(?:T?(?:{name}|\*[Ai]{name}|[BO])(?:,(?:\*[Ai]{name}|[BO]))?ms));|Z(?:={e}|\*(?:[Ai]{name})?ms|T?[BO](?:ms)?|q(?:{fn}|{cls}|{e}))?;?)" if ts else rf"(?:M(?:s|(?:{name}|\*i{name}|[BO])(?:,(?:\*i{name}|[BO]))?ms);|Z(?:\*(?:i{name})?ms;|[BO](?:ms)?;|q(?:{fn}|{cls}|{e};)))"
        more = rf"|z*K(?:{name}(?:\.{name})*|s){genq}(?:x{t}(?:,{t})*)?[CBO]|z*T{name}{genq}=(?:{t}x{t}\?(?:{t}x{t}\?{t}:)*{t}:)*{t};?|z+i(?:s|{name}(?:\.{name})*)?B|z*V?E{name}[BCO]|z+(?:{decl};|{fn}|{cls}|fi{genq}P{ann};)|(?:y?f\*?{name}{genq}P{ann};)" if ts else ""
        stmt = (
            rf"(?:tB(?:gP?B)?(?:lB)?|SP[BO]|(?:@{name}(?:\.{name})*P?;?)*Z?(?:z*)(?:{fn}|{cls})|Z(?:{decl};|B)|{imp}{more.replace('|z*K', '|Z?q?z*K').replace('|z*T', '|Z?z*T').replace('|z*V?E', '|Z?z*V?E')}|(?:k{e}|q):|(?:{head}|e|{name}:(?!:))*(?:B|{simple}|tB(?:gP?B)?(?:lB)?|SP[BO]))"
        )
        return {
            "P": rf"(?:(?:d?{e}(?:,|$))+|(?:{param}(?:,|$))+|{forhead}{'|' + t if ts else ''})?", "Q": rf"(?:(?:(?:d?{e})?(?:,|$))*|{name}:{t or 'i'}|{name}o{t or 'i'}{f'|(?:d?{name}{chr(92)}??:{t}(?:,|$))+|(?:d?{t}{chr(92)}??(?:,|$))+' if ts else ''})", "B": rf"(?:{stmt})*+",
            "O": rf"(?:(?:{prop}(?:,|$))+|{spec})?", "C": rf"(?:(?:@{name}P?;?)*(?:{member})|zB|;)*+" if ts else rf"(?:(?:{member})|zB|;)*+", "file": rf"(?:{stmt})*+",
        }
    if lang == "go":
        t0 = r"(?:[*Q&]|Hh?|hH|mQ)*(?:i(?:\.i)?Q?|CB|CC|CO|P|fP(?:(?:[*Q]|mQ)*(?:i(?:\.i)?|P|CB))?)"
        post = r"(?:\.i|\.P|P|Q|[BO])*"
        opd = rf"(?:[+!*&h])*(?:[ns]|P|i|fP(?:{t0})?B|(?:[*Q]|mQ|H)+{t0}[BO]?|C[BCO][BO]?){post}"
        gop = r"(?:b=?|[+*&|<h]|>[>=]?)"
        e = rf"(?>{opd}(?:{gop}{opd})*)"
        # In the head of a statement a brace opens its block.
        hopd = opd.replace("|P|Q|[BO])*", "|P|Q)*").replace("B|(?:[*Q]|mQ|H)+", "B|(?:[*Q]|mQ|H)+").replace("[BO]?|C[BCO][BO]?", "")
        he = rf"(?>{hopd}(?:{gop}{hopd})*)"
        es = rf"{e}(?:,{e})*"
        ids = r"i(?:,i)*"
        sim = rf"(?:{es}(?:(?:w|=)(?:r?{es})|p|h{e})?)"
        spec = rf"{ids}(?:{t0})?(?:={es})?"
        hsim = rf"(?:{he}(?:,{he})*(?:(?:w|=)(?:r?{he}(?:,{he})*)|p|h{he})?)"
        iff = rf"I(?:{hsim};)?{he}[BO]"
        stmt = (
            rf"(?:;|{iff}(?:e{iff})*(?:eB)?;?|F(?:(?:{hsim})?;(?:{he})?;(?:{hsim})?|(?:{es}[w=])?r{he}|{he})?B;?|S(?:{hsim}?;)?(?:(?:iw)?{he})?[BO];?|(?:k(?:{es}|{sim}|{t0}(?:,{t0})*)|q):|V(?:{spec}|P);?|T(?:iQ?=?{t0}|P);?"
            rf"|R(?:{es})?;?|Ji?;?|G{e};?|i:|B;?|{sim};?)"
        )
        top = rf"(?:;|Zi;|M(?:[i.]?s|P);|V(?:{spec}|P);?|T(?:iQ?=?{t0}|P);?|fP?iQ?P(?:{t0})?B?;?)"
        par = rf"(?:(?:i?(?:,i)*d?{t0})|i)"
        return {
            "P": rf"(?:(?:{e}|{t0})(?:,(?:{e}|{t0}))*d?,?|{par}(?:,{par})*,?|(?:[i.]?s;)*(?:[i.]?s)?|(?:{spec};)*(?:{spec})?|(?:iQ?=?{t0};?)*|T)?", "Q": rf"(?:(?:{e})?(?::(?:{e})?){{0,2}}|d|{t0}|{ids}{t0}(?:,{ids}{t0})*)", "B": rf"(?:{stmt})*+",
            "O": rf"(?:(?:(?:{e}|[BO]):)?(?:{e}|[BO])(?:,(?:(?:{e}|[BO]):)?(?:{e}|[BO]))*,?)?", "C": rf"(?:(?:{ids}{t0}s?|iP(?:{t0})?|\*?i(?:\.i)?s?)(?:;|$)|;)*+", "file": rf";*Zi;(?:{top})*+",
        }
    java = lang == "java"
    if java:
        g0 = r"(?:<[iY?.,x&Q@]*(?:<[iY?.,x&Q@]*(?:<[iY?.,x&Q]*>)?[iY?.,x&Q@]*>[iY?.,x&Q@]*)*>)"
        ty = rf"(?:[iY](?:\.i)*{g0}?(?:\.i)*Q*)"
        gen = rf"{g0}?"
        at = r"(?:@i(?:\.i)*P?)"
        mod = rf"(?:{at}|z|q|W)*"
        post = rf"(?:\.{gen}(?:i|c|u)|P|Q|p|\.{g0}i)*"
        opd = rf"(?:[+!p]|P(?=[insPQuf!]))*(?:(?:[iP]a)+(?:B|(?:[+!p])*(?:[ins]|P|u{ty}P)(?:{post}))|u{ty}(?:P[CB]?|Q*[BO]?)(?:{post})|(?:[ins]|P|Y(?=[.Q]))(?:{post})|SP[BO])"
        op = r"(?:b|[+*&|=]|<|>+=?|b=|<b)"
        e = rf"(?>{opd}(?:{op}{opd}|o(?:z?{ty}i?))*)"
        es = rf"(?>{e}(?:,{e}|\?{e}:{e})*)"
        e = rf"(?>{e}(?:\?{e}:{e})*)"
        init = rf"(?:{e}|[BO])"
        decl = rf"{mod}{ty}(?:iQ*(?:={init})?(?:,(?=i)|(?=[;)]|$)))+"
        head = r"(?:IP|FP|WP)"
        simple = rf"(?:;|{decl};|(?:R(?:{es}(?::{es})?)?|Ji?|{es});|DBWP;)"
        kl = rf"{mod}@?ci{gen}P?(?:x{ty}(?:,{ty})*)*[CBO]"
        stmt = rf"(?:tP?B(?:gPB)*(?:lB)?|SP[BO];?|(?:k(?:{es}|{ty}(?:i|P))(?:,q)?(?:i{e})?|q)(?::|a)|{kl}|(?:{head}|e|i:(?!:))*(?:B|{simple}))"
        par = rf"{mod}{ty}(?:d)?iQ*"
        member = rf"(?:;|{mod}B|{kl}|{mod}{gen}(?:{ty})?iPQ*(?:x{ty}(?:,{ty})*)?(?:B|(?:q(?:{e}|[BO]|{at}))?;)|{decl};|i(?:P)?(?:C|B)?(?:,i(?:P)?(?:C|B)?)*[,;]?)"
        forhead = rf"(?:(?:{decl}|{es})?;(?:{es})?;(?:{es})?|{par}:{e})"
        return {
            "P": rf"(?:{es}|{par}(?:,{par})*|{ty}(?:&{ty})*|{forhead}|{mod}{ty}(?:\|{ty})*i|{decl}(?:;{decl})*;?|(?:i={init})(?:,i={init})*|[BO](?:,[BO])*)?", "Q": rf"(?:{e})?", "B": rf"(?:{stmt})*+",
            "O": rf"(?:{init}(?:,{init})*,?)?", "C": rf"(?:{member})*+", "file": rf"(?:{mod}M(?:z?i(?:\.(?:i|\*))*);|{kl}|;)*+",
        }
    ty = r"(?:(?:AP|z)*(?:Y+z*Y*|C(?:AP)*(?:i?[CBO]|i)|i|z(?=[*i]))(?:AP|z|\*)*)"
    opd = rf"(?:[+!*&pu]|P(?=[insPO!*&+]))*(?:[in]|s+|P|[O])(?:\.i|P|Q|p)*"
    op = r"(?:b|[+*&|=]|<|>+=?|b=)"
    e = rf"(?>{opd}(?:{op}{opd})*)"
    e = rf"(?>{e}(?:\?{e}:{e})*)"
    es = rf"{e}(?:,{e})*"
    init = rf"(?:{e}|[BO])"
    dcl = rf"\**z*(?:i(?:Q*|P)|PP)(?::{e})?(?:AP)*(?:={init})?"
    decl = rf"T?{ty}(?:{dcl}(?:,{dcl})*)?"
    head = r"(?:IP|FP|WP|SP)"
    simple = rf"(?:;|{decl};|(?:R(?:{es})?|J|Gi|{es});|DBWP;)"
    stmt = rf"(?:(?:{head}+|i:)(?:B|{simple})(?:e{head}*(?:B|{simple}))*|(?:k{e}(?:d{e})?|q):|B|{simple})"
    par = rf"(?:z*{ty}\**z*(?:i?Q*|PP)?|d)"
    return {
        "P": rf"(?:{es}|{par}(?:,{par})*|\*+z*i?(?:Q*|P)|(?:{decl}|{es})?;(?:{es})?;(?:{es})?)?", "Q": rf"z*(?:{e})?", "B": rf"(?:{stmt})*+",
        "O": rf"(?:(?:(?:\.i|Q)=)?{init}(?:,(?:(?:\.i|Q)=)?{init})*,?)?", "C": rf"(?:{ty}\**iP(?:AP)*B|(?:{decl}|i(?:={e})?(?:,i(?:={e})?)*,?);?)*+",
        "file": rf"(?:;|{decl};|{ty}\**(?:i|P)P(?:AP)*(?:B|;|(?:{decl};)+B)|iP;|zs[BC])*+",
    }


class Automaton:
    """Automaton of a right part without empty moves, as arrays: the cheapest edits of a span of any length are found
    by one vector of least costs a token, exactly, and traced back to where they lie."""

    def __init__(self, pattern: str):
        self.eps: list[list[int]] = []
        self.arcs: list[list[tuple[int, int]]] = []
        self.sets: dict[frozenset[str], int] = {}
        start, final = self._new(), self._new()
        self._add(sre.parse(pattern), start, final)
        self._compile(start, final)

    def _new(self) -> int:
        self.eps.append([])
        self.arcs.append([])
        return len(self.eps) - 1

    def _arc(self, a: int, chars: frozenset[str], b: int) -> None:
        self.arcs[a].append((self.sets.setdefault(chars, len(self.sets)), b))

    def _add(self, seq, a: int, b: int) -> None:  # noqa: ANN001
        for op, arg in seq:
            c, kind = self._new(), str(op)
            if kind == "LITERAL":
                self._arc(a, frozenset(chr(arg)), c)
            elif kind == "IN":
                chars: set[str] = set()
                for k, v in arg:
                    chars |= {chr(v)} if str(k) == "LITERAL" else {chr(x) for x in range(v[0], v[1] + 1)}
                self._arc(a, frozenset(chars), c)
            elif kind == "BRANCH":
                for alt in arg[1]:
                    self._add(alt, a, c)
            elif kind == "SUBPATTERN":
                self._add(arg[3], a, c)
            elif kind == "ATOMIC_GROUP":
                self._add(arg, a, c)
            elif kind in ("MAX_REPEAT", "POSSESSIVE_REPEAT"):
                lo, hi, sub = arg
                for _ in range(lo if hi != sre.MAXREPEAT else lo - 1):
                    n = self._new()
                    self._add(sub, a, n)
                    a = n
                if hi == sre.MAXREPEAT:
                    loop, n = self._new(), self._new()
                    self.eps[a].append(loop)
                    self._add(sub, loop, n)
                    self.eps[n] += [loop, c]
                    if not lo:
                        self.eps[a].append(c)
                else:
                    self.eps[a].append(c)
                    for _ in range(hi - lo):
                        n = self._new()
                        self._add(sub, a, n)
                        self.eps[n].append(c)
                        a = n
            else:  # looking ahead costs nothing
                self.eps[a].append(c)
            a = c
        self.eps[a].append(b)

    def _compile(self, start: int, final: int) -> None:
        """States are kept that an arc leads to, and the start; an arc leaves a state if it leaves what empty moves reach."""
        heads = sorted({t for arcs in self.arcs for _, t in arcs} | {start})
        number = {h: i for i, h in enumerate(heads)}
        src, dst, kind, last = [], [], [], []
        for h in heads:
            seen, todo = {h}, [h]
            while todo:
                for t in self.eps[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            last.append(final in seen)
            out = {x for q in seen for x in self.arcs[q]}
            src += [number[h]] * len(out)
            kind += [c for c, _ in out]
            dst += [number[t] for _, t in out]
        src, dst, kind = np.array(src, dtype=np.int64), np.array(dst, dtype=np.int64), np.array(kind, dtype=np.int64)
        # States from which the same texts are accepted are one: their classes are refined until they stay.
        own, n = np.array(last, dtype=np.int64), 0
        while own.max(initial=0) + 1 > n:
            n = int(own.max(initial=0)) + 1
            arc = np.unique((src << 40) | (kind << 24) | own[dst])
            h = _mix(own.astype(np.uint64) + np.uint64(1))
            np.add.at(h, arc >> 40, _mix((arc & ((1 << 40) - 1)).astype(np.uint64)))
            own = np.unique(h, return_inverse=True)[1].astype(np.int64).ravel()
        arc = np.unique((own[dst] << 40) | (own[src] << 16) | kind)
        sets = list(self.sets)
        self.dst, self.src, self.chars = arc >> 40, (arc >> 16) & ((1 << 24) - 1), [sets[k] for k in arc & 0xFFFF]
        self.first = np.flatnonzero(np.diff(self.dst, prepend=-1))
        accepting = np.zeros(n, dtype=bool)
        accepting[own[np.array(last)]] = True
        self.heads, self.start, self.last, self.n = self.dst[self.first], int(own[number[start]]), accepting, n
        self.miss: dict[str, np.ndarray] = {}
        self.eps, self.arcs = [], []

    def _spread(self, v: np.ndarray) -> np.ndarray:
        """Inserted tokens: along any arc at a cost of 1."""
        while True:
            w = np.minimum.reduceat(v[self.src], self.first) + 1
            if not (w < v[self.heads]).any():
                return v
            v[self.heads] = np.minimum(v[self.heads], w)

    def _step(self, v: np.ndarray, ch: str) -> np.ndarray:
        if ch not in self.miss:
            self.miss[ch] = np.array([ch not in c for c in self.chars], dtype=np.int32)
        out = v + 1  # deleted
        w = np.minimum.reduceat(v[self.src] + self.miss[ch], self.first)
        out[self.heads] = np.minimum(out[self.heads], w)
        return self._spread(out)

    #: Cost vectors between two that are kept; the rest is made again for the way back.
    STRIDE = 256

    def edits(self, text: str) -> list[int]:
        """Positions of the fewest inserted, deleted or replaced tokens that make ``text`` acceptable, in order; an
        insertion at the end has the text's length."""
        v = np.full(self.n, 1 << 20, dtype=np.int32)
        v[self.start] = 0
        v = self._spread(v)
        kept = {0: v}
        for i, ch in enumerate(text, 1):
            v = self._step(v, ch)
            if i % self.STRIDE == 0:
                kept[i] = v
        s = int(np.where(self.last, v, 1 << 20).argmin())
        out: list[int] = []
        i = len(text)
        row: dict[int, np.ndarray] = {}
        while True:
            if i not in row:
                base = (i - 1) // self.STRIDE * self.STRIDE if i else 0
                row = {base: kept[base]}
                for j in range(base, i):
                    row[j + 1] = self._step(row[j], text[j])
            cost = row[i][s]
            if i == 0 and s == self.start and cost == 0:
                return out[::-1]
            lo, hi = np.searchsorted(self.dst, s), np.searchsorted(self.dst, s, "right")
            into = self.src[lo:hi]
            if i:
                if i - 1 not in row:
                    below = (i - 1) // self.STRIDE * self.STRIDE
                    row = {below: kept[below], i: row[i]}
                    for j in range(below, i - 1):
                        row[j + 1] = self._step(row[j], text[j])
                before, miss = row[i - 1], self.miss[text[i - 1]][lo:hi]
                hit = np.flatnonzero(before[into] + miss == cost)
                if len(hit):
                    free = hit[miss[hit] == 0]
                    k = int(free[0]) if len(free) else int(hit[0])
                    i -= 1
                    if miss[k]:
                        out.append(i)
                    s = int(into[k])
                    continue
                if before[s] + 1 == cost:
                    i -= 1
                    out.append(i)
                    continue
            k = int(np.flatnonzero(row[i][into] + 1 == cost)[0])
            out.append(i)
            s = int(into[k])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_PAIRS = {")": "(", "]": "[", "}": "{", "⟩": "⟨"}
#: Bytes of a chart that are kept in memory; a larger one lies in a file, which changes nothing else.
IN_MEMORY = 1 << 29


def unmatched(brackets: Iterable[tuple[str, int]]) -> list[tuple[str, int]]:
    """What is left of (bracket, place) when neighbours that match are taken away until there are none, which leaves the
    fewest edits as they are. One that matches nothing stands between those around it: of ``[{]}`` all four are left."""
    out: list[tuple[str, int]] = []
    for c, at in brackets:
        if out and _PAIRS.get(c) == out[-1][0]:
            out.pop()
        else:
            out.append((c, at))
    return out


def bracket_edits(s: str) -> list[int]:
    """Positions in a string of brackets, of which no two neighbours match, of the fewest edits that balance it.

    Where all closing ones come before all opening ones, two of a kind of side are repaired by one edit. Else a chart
    over spans decides, whatever the length: a row holds the costs of all spans from one place on, and a pair is tried
    with all that can follow it only if it costs less than what was found for its own span."""
    n = len(s)
    shut = next((i for i, c in enumerate(s) if c not in _PAIRS), n)
    if all(c not in _PAIRS for c in s[shut:]):
        return [*range(0, shut, 2), *range(shut, n, 2)]
    size = np.dtype(np.uint16 if n < 65_000 else np.uint32)
    # For each bracket what it costs to pair it with the one at each place behind it.
    fit = {a: np.array([int(_PAIRS.get(b) != a) if a not in _PAIRS or b in _PAIRS else 2 for b in s], dtype=size) for a in set(s)}
    if (n + 1) ** 2 * size.itemsize > IN_MEMORY:
        best = np.asarray(np.memmap(tempfile.TemporaryFile(), dtype=size, mode="w+", shape=(n + 1, n + 1)))
    else:
        best = np.empty((n + 1, n + 1), dtype=size)
    best[n, n] = 0
    for i in range(n - 1, -1, -1):
        row, inner = best[i], best[i + 1]
        row[i] = 0
        np.add(inner[i + 1 :], 1, out=row[i + 1 :])
        pair = fit[s[i]][i + 1 :] + inner[i + 1 : -1]
        k = i + 1
        while k < n:
            less = pair[k - i - 1 :] < row[k + 1 :]
            m = int(less.argmax())
            if not less[m]:
                break
            k += m + 1
            np.minimum(row[k:], best[k, k:] + pair[k - i - 2], out=row[k:])
    out: list[int] = []
    todo = [(0, n)]
    while todo:
        i, j = todo.pop()
        if i >= j:
            continue
        w = fit[s[i]][i + 1 : j] + best[i + 1, i + 1 : j] + best[i + 2 : j + 1, j]
        m = int(w.argmin()) if len(w) else -1
        if m < 0 or w[m] > best[i + 1, j] + 1:
            out.append(i)
            todo.append((i + 1, j))
        else:
            k = i + 1 + m
            cost = fit[s[i]][k]
            if cost:
                out += [k] if cost == 1 else [i, k]
            todo += [(i + 1, k), (k + 1, j)]
    return sorted(out)


class Parser:
    """Chart parser of one language; spans that were parsed once are kept."""

    def __init__(self, lang: str):
        self.lang = lang
        self.classes = Classes(lang)
        self.parts = _grammar(lang)
        self.accept = {k: re.compile(v).fullmatch for k, v in self.parts.items()}
        self.prefix = {k: re.compile(self.parts[k].removeprefix(";*Zi;")).match for k in ("B", "C", "file") if k in self.parts}
        self.units: dict[tuple[str, str], list[int]] = {}
        self.automata: dict[str, Automaton] = {}
        self.known: dict[str, tuple[str, list[int]]] = {}
        self.brackets = re.compile(r"[()\[\]{}⟨⟩]")

    def automaton(self, part: str) -> Automaton:
        pattern = self.parts[part].replace("*+", "*").replace("++", "+")
        if pattern not in self.automata:
            self.automata[pattern] = Automaton(pattern)
        return self.automata[pattern]

    def prepared(self) -> dict[str, Automaton]:
        """All automata of the language, by their patterns."""
        for part in self.parts:
            self.automaton(part)
        return self.automata

    def _repair(self, part: str, text: str) -> list[int]:
        """Positions of the edits of a span. In a list of statements or members acceptance goes as far as it can; each
        statement where it ends is repaired by itself, and acceptance goes on behind it."""
        if part not in ("B", "C", "file") or self.lang == "json":
            return self.automaton(part).edits(text) or [0]
        out: list[int] = []
        at = 0
        while at < len(text):
            m = self.prefix[part](text, at)
            if m and m.end() >= len(text):
                break
            at = m.end() if m else at
            end = min((i + 1 for i in (text.find(c, at) for c in ";BCO") if i >= 0), default=len(text))
            key = (part, text[at:end])
            if key not in self.units:
                if len(self.units) > 100_000:
                    self.units.clear()
                self.units[key] = self.automaton(part).edits(key[1])
            out += [at + i for i in self.units[key]]
            at = end
        return out or [len(text)]

    def group(self, text: str) -> tuple[str, list[int]]:
        """(nonterminal, positions of edits inside) of a bracketed span."""
        got = self.known.get(text)
        if got is None:
            if len(self.known) > 400_000:
                self.known.clear()
            kind, body = text[0], text[1:-1]
            parts = {"(": "P", "[": "Q", "{": "O" if self.lang in ("py", "json") else "BOC", "⟨": "B"}[kind]
            # The last statement of a block needs no semicolon where lines end statements.
            loose = kind == "{" and self.lang in ("js", "ts") and body
            got = next(((p, []) for p in parts if self.accept[p](body) or loose and p != "O" and self.accept[p](body + ";")), None)
            if got is None:
                # Of the nonterminals that the bracket may be the one that is repaired with the fewest edits.
                got = min(((p, self._repair(p, body)) for p in parts), key=lambda x: len(x[1]))
            if len(text) < 4000:
                self.known[text] = got
        return got

    def parse(self, text: str) -> tuple[str, list[int]]:
        """(token classes, positions in them of the edits of a least repair); a file that parses has none. Groups are
        closed on a stack, so any nesting takes one pass."""
        s = self.tokens(text)
        edits = [m.start() for m in re.finditer("X", s)]
        if edits:
            s = s.replace("X", "i")
        # A frame: its bracket, where that stands, its pieces and where they come from.
        stack: list[tuple[str, int, list[str], list[int]]] = [("", -1, [], [])]
        lost = False
        last = 0
        for m in self.brackets.finditer(s):
            at, c = m.start(), m[0]
            top = stack[-1]
            if at > last:
                top[2].append(s[last:at])
                top[3].append(last)
            last = at + 1
            if c not in _PAIRS:
                stack.append((c, at, [], []))
            elif top[0] == _PAIRS[c]:
                stack.pop()
                self._close(top, c, stack[-1], edits)
            else:
                lost = True
        if last < len(s):
            stack[-1][2].append(s[last:])
            stack[-1][3].append(last)
        if lost or len(stack) > 1:
            broken = unmatched((m[0], m.start()) for m in self.brackets.finditer(s))
            wrong = bracket_edits("".join(c for c, _ in broken))
            # Groups that nothing closes are closed at the end of the text, and what they hold is parsed as it is.
            edits += [broken[i][1] if lost else len(s) for i in wrong]
            while len(stack) > 1:
                top = stack.pop()
                self._close(top, {v: k for k, v in _PAIRS.items()}[top[0]], stack[-1], edits)
        root = "".join(stack[0][2])
        got = self.known.get(root) if len(root) < 400 else None
        if got is None:
            got = ("file", [] if self.accept["file"](root) else self._repair("file", root))
            if len(root) < 400:
                self.known[root] = got
        edits += self._places(stack[0], got[1], len(s))
        return s, sorted(edits)

    def _close(self, frame: tuple[str, int, list[str], list[int]], c: str, parent: tuple[str, int, list[str], list[int]], edits: list[int]) -> None:
        body = "".join(frame[2])
        part, wrong = self.group(frame[0] + body + c)
        if wrong:
            end = frame[3][-1] + len(frame[2][-1]) if frame[2] else frame[1] + 1
            edits += self._places(frame, wrong, end)
        parent[2].append(part)
        parent[3].append(frame[1])

    @staticmethod
    def _places(frame: tuple[str, int, list[str], list[int]], wrong: list[int], end: int) -> list[int]:
        """Where positions of a frame's body lie in the file's tokens."""
        if not wrong:
            return []
        starts = np.cumsum([0, *map(len, frame[2])])
        out = []
        for w in wrong:
            k = int(np.searchsorted(starts, w, "right")) - 1
            out.append(end if k >= len(frame[2]) else frame[3][k] + (w - int(starts[k]) if len(frame[2][k]) > 1 else 0))
        return out

    def clean(self, text: str) -> str:
        text = _plain(text)
        return _first_branches(text) if self.lang == "c" else text

    def tokens(self, text: str) -> str:
        return self._classes(text)[0]

    def lines(self, text: str) -> list[int]:
        """The line of every token class of :meth:`tokens`, from 0."""
        text = self.clean(text)
        lead = 1 if self.lang == "py" else 0
        ends = [m.start() + lead for m in re.finditer("\n", text)]
        found, line = [], []
        for m in _LEX[self.lang].finditer("\n" + text if lead else text):
            found.append(m[0])
            line.append(bisect.bisect_left(ends, m.start()))
        _, where = self._classes(text, found)
        return [line[min(w, len(line) - 1)] for w in where] if line else []

    def _classes(self, text: str, found: list[str] | None = None) -> tuple[str, list[int]]:
        """Token classes, and with ``found`` for each the number of its token."""
        track = found is not None
        if found is None:
            text = self.clean(text)
            found = _LEX[self.lang].findall("\n" + text if self.lang == "py" else text)
        if self.lang == "py":
            return self._indented(found)
        each = list(map(self.classes.__getitem__, found))
        s = _MEMBER.sub("i", "".join(each)) if self.lang not in ("json", "c") else "".join(each)
        where = [i for i, c in enumerate(each) for _ in c] if track else []
        if self.lang == "go":
            s, where = _swap(r"(?<=[ins)\]}pRJ])\n+", s + "\n", [*where, len(found)] if track else [], track)
        elif self.lang in ("js", "ts"):
            s, where = _swap(_ASI, s, where, track)
        return s, where

    def _indented(self, found: list[str]) -> tuple[str, list[int]]:
        out: list[str] = []
        where: list[int] = []
        stack, depth, start, get = [0], 0, True, self.classes.__getitem__
        pending: str | None = ""
        head = lambdas = 0  # in the head of a compound statement, and lambdas whose colon is to come
        inline = False  # behind such a head on its line: a block of its own

        def put(c: str, i: int) -> None:
            out.append(c)
            where.extend([i] * len(c))

        for i, t in enumerate(found):
            if t[0] == "\n":
                if depth == 0:
                    pending = t[1:]
                    if not start:
                        if head != 2:
                            put(";", i)
                        start, head = True, 0
                        if inline:
                            put("⟩", i)
                        inline = False
                continue
            c = get(t)
            if not c:
                continue
            if head == 2:
                put("⟨", i)
                head, inline = 0, True
            if start:
                start = False
                head, lambdas = int(c in "IEeFWtglDcwy" or t in ("case", "match") and found[i + 1 : i + 2] not in (["="], ["."], [","], ["("], [":"], [")"])), 0
                if t == "type" and _NAME.match("".join(found[i + 1 : i + 2])):
                    c = ""
                width = len((pending or "").expandtabs(8))
                if width > stack[-1]:
                    stack.append(width)
                    put("⟨", i)
                elif width < stack[-1]:
                    while len(stack) > 1 and width < stack[-1]:
                        stack.pop()
                        put("⟩", i)
                    if width != stack[-1]:
                        put("X", i)
            if c and c in "([{":
                depth += 1
            elif c and c in ")]}" and depth:
                depth -= 1
            if head and not depth:
                lambdas += c == "L"
                if c == ":":
                    head, lambdas = (2, 0) if not lambdas else (head, lambdas - 1)
            put(c, i)
        if not start:
            put(";", len(found))
            if inline:
                put("⟩", len(found))
        for _ in stack[1:]:
            put("⟩", len(found))
        return "".join(out), where


#: A keyword behind a point is a name like any other.
_MEMBER = re.compile(r"(?<=\.)[A-Za-mo-rt-z]")
#: Where a line end stands for a semicolon in scripts.
_ASI = r"(?<=[insRJpyzmQ)\]}])\n+(?=[insVfcIFWDSRJtMZkqyupzTKE@!])|(?<=[insRJp)\]])\n+(?=[em])|(?<=[insRJpPQ)\]}])\n*$"


def _plain(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text[1:] if text.startswith("\ufeff") else text


_BRANCH = re.compile(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|else|elif|elifdef|elifndef|endif)\b(.*)$", re.M)


def _first_branches(text: str) -> str:
    """A C text with only one branch of each conditional, the first, or the second of ``#if 0``; lines stay where they are."""
    if "#" not in text or "else" not in text and "elif" not in text and not re.search(r"#[ \t]*if[ \t]+0", text):
        return text
    out, last = [], 0
    stack: list[list[bool]] = []  # of each open conditional: is text kept in it, has a branch been kept
    for m in _BRANCH.finditer(text):
        part = text[last : m.start()]
        out.append(part if all(k for k, _ in stack) else "\n" * part.count("\n"))
        last = m.start()
        if m[1] in ("if", "ifdef", "ifndef"):
            keep = not (m[1] == "if" and m[2].strip() == "0")
            stack.append([keep, keep])
        elif stack and m[1] == "endif":
            stack.pop()
        elif stack:
            stack[-1] = [not stack[-1][1], True]
    part = text[last:]
    out.append(part if all(k for k, _ in stack) else "\n" * part.count("\n"))
    return "".join(out)


def _swap(pattern: str, s: str, where: list[int], track: bool) -> tuple[str, list[int]]:
    """``s`` with a semicolon for each match and without the line ends that are left, and whence its characters come."""
    if not track:
        return re.sub(pattern, ";", s).replace("\n", ""), where
    out, at, last = [], [], 0
    for m in [*re.finditer(pattern, s), None]:
        lo, hi = (m.start(), m.end()) if m else (len(s), len(s))
        for i in range(last, lo):
            if s[i] != "\n":
                out.append(s[i])
                at.append(where[i])
        if m:
            out.append(";")
            at.append(where[lo] if lo < len(where) else (where[-1] if where else 0))
        last = hi
    return "".join(out), at


_NAME = re.compile(r"[^\W\d]\w*$")


@cache
def parser(lang: str) -> Parser:
    return Parser(lang)


_MARKER = re.compile(r"^(?:<{7}|>{7}|={7}|\|{7})(?: |$)")


def _exact(text: str, lang: str) -> bool:
    """Whether Python's own parsers accept a text that the chart flags."""
    try:
        if lang == "json":
            json.loads(text)
        else:
            ast.parse(text.replace("\r\n", "\n"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def cause_of(lines: list[str], at: list[int], tokens: int = 1 << 30) -> str:
    """What edits on these lines, in order, speak for: ``conflict`` if one lies between the marker lines of a merge,
    ``truncation`` if all lie at the end of what is written, ``mismatch`` if they are spread over the file or
    more than a tenth of its ``tokens``, and ``local`` if they are few and close together."""
    end = max((i for i, x in enumerate(lines) if x.strip()), default=0)
    marks = [i for i, x in enumerate(lines) if _MARKER.match(x)]
    # From each mark to the next one of the same merge; a mark alone is a region by itself.
    inside = set(marks) | {k for a, b in zip(marks, marks[1:]) if lines[b][0] in "=|>" for k in range(a, b + 1)}
    if any(k in inside for i in at for k in (i - 1, i, i + 1)):
        return "conflict"
    if all(i >= end - 1 for i in at):
        return "truncation"
    spread_ = len({i * 8 // (end + 1) for i in at})
    return "mismatch" if spread_ >= 3 or len(at) > 3 and len(at) * 10 > tokens else "local"


def check(text: str, lang: str) -> tuple[int, str | None]:
    """(repair cost, cause): cause is null if the file parses, see :func:`cause_of`."""
    p = parser(lang)
    s, edits = p.parse(text)
    if not edits or lang in ("py", "json") and _exact(text, lang):
        return 0, None
    line = p.lines(text)
    lines = _plain(text).split("\n")
    end = max((i for i, x in enumerate(lines) if x.strip()), default=0)
    return len(edits), cause_of(lines, [line[e] if e < len(line) else end for e in edits], len(s))


def repairs(chunks: DataFrame) -> DataFrame:
    """(repo, file_path, language, cost, cause): every file of a checked extension with its least repair cost; 0 if
    it parses. The language is that of the extension, whatever the chunks say. An empty file parses, except as
    JSON. Rows with null repo, path, offset or content are left out; an empty table gives none."""
    text = assemble(chunks, extension("file_path").isin(*LANGUAGES))

    # Automata are made once, here: minimal, they are a few hundred KB.
    sent = chunks.sparkSession.sparkContext.broadcast({x: parser(x).prepared() for x in LANGUAGES})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, made in sent.value.items():
            parser(x).automata.update(made)
        for b in batches:
            lang = [p.rsplit(".", 1)[-1].lower() for p in b.column(1).to_pylist()]
            got = [check(t, x) for t, x in zip(b.column(2).to_pylist(), lang)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([LANGUAGES[x] for x in lang]), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.string())],
                names=["repo", "file_path", "language", "cost", "cause"],
            )

    return text.mapInArrow(run, "repo string, file_path string, language string, cost int, cause string")


def rates(found: DataFrame) -> DataFrame:
    """(repo, language, files, broken, rate) of the result of :func:`repairs`."""
    return found.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(F.col("cost") > 0).alias("broken")).withColumn("rate", F.round(F.col("broken") / F.col("files"), 6))



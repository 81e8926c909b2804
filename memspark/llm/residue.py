"""Texts that are residue: unfilled templates, filler, error pages, script notices.

Labelled exemplars are held in an inverted index from terms to exemplars. A
text is cut into passage windows (sentences and lines); a window retrieves the
exemplars that it contains whole and is measured by TF-IDF containment the
other way: how much of its weight they explain together. Terms are concepts: words of
one meaning (found, find, gefunden, 找到) are one term, so an exemplar stands
for every wording of what it says. Term weights come from the document
frequencies of the whole corpus. Exemplars of the label `mention` are texts
that quote, explain or report residue: a window that contains one is left
alone. Exemplars were written from what servers, browsers, frameworks, office
programs and template engines are known to print; none was taken from a corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.pii import PLACEHOLDERS
from memspark.tables import cut, spread


@dataclass(frozen=True)
class Coverage:
    """A window is residue if the exemplars of one label that it contains explain `explained` of its weight.

    run: the words a window must have to be repetition or Latin.
    """

    explained: float = 0.42
    run: int = 4


# Words of one meaning, by the term that stands for them; Han words are cut before single characters.
CONCEPTS = {
    "unexpected": "unexpected unknown unerwarteter unerwarteten unerwartet unbekannter 意外 未知",
    "occur": "occurred happened aufgetreten 发生",
    "internal": "internal interner interne 内部",
    "page": "page pages site website webpage url seite webseite website 页面 网页 网址 网站 本站 链接",
    "thing": "resource item file document object note notes entry record topic post article notiz eintrag datei 资源 文件 文章 笔记",
    "not": "not no never cannot can't couldn't isn't doesn't don't wasn't won't unable without nicht kein keine ohne nie 不 未 无法 没有 无 不能 不可",
    "find": "find found locate located gefunden finden 找到 找 发现",
    "exist": "exist exists existed existing available vorhanden existiert verfügbar 存在 可用",
    "gone": "gone lost missing broken archived discontinued removed moved deleted renamed entfernt verschoben gelöscht 删除 移动 下线 失效",
    "deny": "denied refused prohibited restricted blocked verweigert verboten gesperrt 拒绝 禁止 封禁",
    "access": "access permission permissions authorized authorised authorization authorisation rights privileges berechtigung zugriff zugang rechte 权限 无权 授权",
    "visit": "visit view viewed open see display displayed show shown access load loaded loading requested asked looking anzeigen angezeigt öffnen aufrufen angefordert 访问 查看 显示 浏览 打开 加载",
    "session": "session sitzung login 会话 登录状态 登录",
    "expire": "expired timed timeout ended invalid abgelaufen ungültig 过期 超时 失效",
    "sign": "sign signin log login anmelden einloggen melden 登录 登陆",
    "again": "again try retry reload refresh erneut nochmals neu 重试 重新 再试 再次 刷新",
    "later": "later soon moment shortly minutes seconds minute second while später kurz bald augenblick 稍后 稍候 片刻 马上 秒 分钟",
    "now": "now currently presently right momentarily zurzeit derzeit momentan gerade 现在 目前 当前",
    "connection": "connection line socket verbindung 网络连接 连接 网络",
    "close": "closed close closes reset dropped aborted geschlossen 关闭 断开 中断",
    "real": "real actual own proper echten richtige richtigen tatsächlichen 真实 实际 正式",
    "number": "one two three four few some several zwei drei einige 两 三 几",
    "service": "service server system app application viewer player editor backend workspace host upstream dienst anwendung 服务 服务器 系统 应用 本应用 站点",
    "down": "unavailable down offline unreachable overloaded erreichbar überlastet 繁忙 忙 维护 宕机 不可用",
    "maintenance": "maintenance scheduled upgrade wartung wartungsarbeiten 维护 升级",
    "error": "error errors fehler wrong failed failure oops sorry schiefgelaufen whoops 错误 出错 异常 失败 抱歉 故障 对不起",
    "request": "request requests anfragen anfrage traffic 请求",
    "many": "many rate limit exceeded slow viele zu 过多 太多 过于 频繁 限制",
    "browser": "browser browsers 浏览器",
    "complete": "complete completed finish solve 完成",
    "check": "checking checked check verify verifying verification verified validate prove prüfen geprüft überprüft captcha human robot 检查 验证 安全检测 确认",
    "script": "javascript script scripts scripting js noscript skripte skript 脚本 javascript",
    "enable": "enable enabled activate activated allow allowed turn switch switched require required requires needs need needed support supports aktivieren aktiviert einschalten erlauben benötigt erforderlich 启用 开启 打开 允许 需要 支持",
    "disable": "disable disabled off inactive deactivated deaktiviert ausgeschaltet 禁用 停用",
    "work": "work works run runs start starts function functions properly läuft funktioniert starten ausführen 运行 使用 工作 功能",
    "continue": "continue proceed go fortzufahren fortfahren weiter weiterlesen 继续",
    "cookie": "cookie cookies",
    "please": "please bitte 请",
    "you": "you your you're ihr ihre ihren ihrem sie 您 您的 你 你的 用户",
    "contact": "contact administrator admin support webmaster kontaktieren administrator 联系 管理员 客服",
    "gateway": "gateway proxy 网关",
    "text": "text texte content copy body paragraph absatz inhalt 内容 文本 文字 正文 段落",
    "here": "here hier below 这里 此处 在此 处",
    "put": "insert add enter type write replace fill put provide edit schreiben einfügen ersetzen eingeben ergänzen 输入 填写 替换 添加 补充 编辑",
    "sample": "sample example placeholder dummy filler beispiel platzhalter 示例 占位 样例 占位符",
    "sampletext": "beispieltext platzhaltertext blindtext mustertext fülltext 占位文本 示例文本 占位文字 示例文字 示例段落",
    "pending": "coming follow follows folgt tba later soon todo wip später 待 稍后 即将 暂",
    "describe": "describe describes description summary title heading sentence sentences words name short beschreibung titel zusammenfassung satz 描述 标题 摘要 说明 概述",
}
# Exemplars as terms of CONCEPTS and words; {} stands for a sure placeholder, ?? for a doubtful one, 400 for a status from 400 to 599, ** for repetition, ~~ for Latin.
EXEMPLARS = {
    "template": [
        "{}", "dear ??", "hello ??", "hi ??", "sehr geehrte ??", "liebe ??", "hallo ??", "您好 ??", "尊敬 ??", "owner ??", "author ??", "title ??", "date ??", "name ??", "subject ??", "status ??", "version ??", "assigned ??", "prepared by ??", "reviewed by ??", "approved by ??",
        "next review ??", "due ??", "deadline ??", "client ??", "company ??", "address ??", "phone ??", "email ??", "signed ??", "page describe ??", "welcome ??", "report of ??", "between ?? and ??", "release ??", "contains ?? changes", "project ??", "team ??", "location ??", "version ?? of ??", "status of ?? on ?? open", "last reviewed by ??",
        "verantwortlich ??", "datum ??", "titel ??", "nächste prüfung ??", "stand von ??", "负责人 ??", "日期 ??", "时间 ??", "地点 ??", "标题 ??", "姓名 ??", "项目 ??", "欢迎 ??", "会议 ??", "?? 完成", "由 ?? 汇总", "下一步 ??", "本周 ??",
    ],
    "filler": [
        "lorem ipsum", "dolor sit amet", "~~", "**", "text here", "put text", "put text here", "put describe", "sample text", "text pending", "text pending sample", "describe pending", "put sample text", "sampletext", "sampletext pending", "put sampletext", "sampletext put please", "put text describe", "put describe here", "lorem", "put describe describe", "put please text", "text put sample", "text pending put", "sample text put please",
        "you text here", "you text goes here", "text goes here", "put real text", "put real text please", "sample text put", "put number describe here", "put number describe about", "real text later here", "quick brown fox jumps over lazy dog", "text be here", "text later here", "body copy", "to be written", "to be added", "to be determined", "click to put text", "此处 put text",
    ],
    "error": [
        "error 400", "http error 400", "status 400", "service said 400", "page not find", "page not exist", "page gone not exist", "page has been gone", "page may have been gone", "it may have been gone", "thing not find", "thing not exist", "thing has been gone", "text not exist longer", "visit page not exist", "visit gone not exist", "page visit gone", "page not visit", "page looks gone error",
        "access deny", "not access visit", "not access contact", "you not access visit thing", "you not access visit page", "you not access", "visit page deny", "session expire", "you session expire", "session expire again session", "please again session", "sign again", "please sign again", "session expire sign again", "please sign continue", "please sign visit page", "please sign you sich an",
        "error service", "error service internal", "internal error", "something error", "something went error", "error our side", "error occur", "unexpected error", "unexpected error occur", "please again later", "again later", "again later 0", "service down", "service down now", "service not exist now", "down now", "service maintenance", "service not exist", "service not down", "service down maintenance", "page maintenance", "page down maintenance", "page down later", "page down now", "page down again later", "maintenance later", "maintenance now", "be back later",
        "request many", "request many again", "many again later", "slow down again later", "visit many again", "visit many check continue", "visit many please check continue", "please complete check continue", "check browser", "check you browser", "check you browser visit", "later check browser", "check you human", "check you human complete", "check you human complete action", "check page connection secure",
        "gateway bad", "gateway error", "gateway expire", "connection expire", "connection expire again", "connection expire please again", "service close connection", "service close early", "connection close", "connection close early", "service close connection early expire", "service close connection page", "service not respond", "contact error", "error please contact", "error message not", "error code message", "page not working", "bad request", "application error", "page not be reached",
        "unsupported browser", "whitelabel error page", "cloudflare ray id", "apache server at port", "the request url was not find on this service", "no such key", "the page you follow may be gone",
    ],
    "script": [
        "enable script", "script enable", "please enable script", "please enable script visit", "please enable script visit page", "please enable script visit thing", "please enable script continue", "you enable script run", "not work not script", "not script", "not script visit", "not work script disable", "script disable", "script disable browser", "you browser script disable", "you browser not enable script", "enable script cookie", "enable script cookie continue", "check script enable", "nothing check script enable", "page enable script", "service enable script", "service enable script work", "service work script enable",
        "enable reload", "enable them again", "enable them on again", "script not exist browser", "not visit script", "work only script enable", "load script enable", "visit page you script enable", "you must have script enable", "not support script", "script deny", "script deny browser", "please visit browser script", "visit browser script", "browser not support script", "browser enable script",
    ],
    "mention": [
        "{} expanded", "{} replaced", "{} replaces", "{} replace", "{} rendered", "{} escaped", "{} literal", "{} syntax", "{} variable", "{} parameter", "{} parameters", "{} placeholder", "{} printed", "{} prints", "{} set by", "{} skipped", "{} bind", "{} importer", "{} shell", "{} never leave", "{} style guide", "{} template engine", "{} 替换", "{} 变量", "{} 渲染", "{} ersetzt", "{} platzhalter",
        "?? printed", "?? prints", "?? missing", "?? skipped", "?? returned", "?? key", "?? format", "?? log",
        "traced", "fixed", "fix", "came back times", "last night", "logged out", "banner", "reviewers", "fixture", "block", "feedback", "adjusted", "测试", "反馈", "我们", "调整", "behoben", "trat auf", "erscheint", "hinweis", "meldung",
    ],
}
# The reason phrases of HTTP.
STATUS = ["Bad Request", "Unauthorized", "Payment Required", "Forbidden", "Not Found", "Method Not Allowed", "Not Acceptable", "Request Timeout", "Conflict", "Gone", "Too Many Requests", "Internal Server Error", "Not Implemented", "Bad Gateway", "Service Unavailable", "Gateway Timeout", "Gateway Time-out"]
EXEMPLARS["error"] += [f.format(s.lower().replace("-", " ")) for s in STATUS for f in ("400 {}", "error 400 {}", "status 400 {}", *["{}"] * (s not in ("Gone", "Conflict")))]
# The first words of the filler that typesetters use, endings of Latin words, and short words that texts of living languages hold.
LATIN = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore et dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
ENDINGS = ("a", "ae", "am", "as", "em", "es", "et", "i", "im", "is", "it", "nt", "o", "or", "os", "um", "us")
LIVING = frozenset("the of and to is are was were be been has have had for with on by this that from as it its we you they he she not der die das den dem des und ist sind war ein eine einen mit von zu auf für im nicht le la les des du une est sont dans pour que qui el los las del una por con para como se su al y e il lo gli che di da della per sono un uno os um uma com não na no ao mais does do did will would can if in at or but then them there me my our us any all so what which who when where how just only also goes go went said says more most some been about into over after before be must should may might looks like we're i'm it's that's you've kann können werden wird wurde haben hat".split())
# Common Han characters. What holds no content weighs GLUE at most.
COMMON_HAN = frozenset("的了已后并在正该此本是有和与将被为这那其于以及可就都要会到对上下中个也但而或等时从")
GLUE = 0.5
# Bracketed capitals that are content: levels of log lines, and what personal data is replaced by.
LEVELS = "TRACE VERBOSE DEBUG INFO NOTICE WARN WARNING ERROR SEVERE FATAL CRITICAL ALERT EMERG EMERGENCY PANIC".split()
BRACKETED = rf"\[(?!(?:{'|'.join([*LEVELS, *(p[1:-1] for p in PLACEHOLDERS.values())])})\])[A-Z]{{4,}}\]"
# Forms of placeholders, of any length: those of template engines and of forms, and those that other texts may hold too.
SURE = [
    r"\{\{[^{}\n]+\}\}", r"\{\{ *[\w.\-]+(?: [\w.\-]+)? ?(?=$|\W)", r"\{ \{[^{}\n]+\} \}", r"\{%[^%\n]+%\}", r"<%[^%\n]+%>", r"\$\{[^{}\n]+\}", r"#\{[^{}\n]+\}", r"@@\w+@@", r"%\(\w+\)s", r"%[A-Z][A-Z_]+%", r"__[A-Z][A-Z_]*__", r"\$[A-Z][A-Z_]+\$",
    r"«[^«»\n]+»", r"&lt;[\w ]+&gt;", r"<[A-Z]{3,}(?:_[A-Z]+)*>", r"<[\w ]+ (?:goes here|ergänzen|einfügen)>", r"\[(?i:insert|enter|your|add) [^\[\]\n]+\]", r"\[[A-Z]{2,}(?: [A-Z]+)+\]", r"(?<![A-Za-z0-9_])(?:TBD|TODO)_[A-Z_]+", r"\[[^\[\]\n]+ ?(?:einfügen|ergänzen|eintragen)\]",
    r"【(?:请|待|此处)[^【】\n]*】", r"[（(](?:此处|请在此)[^（）()\n]*[）)]", r"X{4}-XX-XX", r"(?<![A-Z])TT\.MM\.J{2,4}", r"××年×月×日", r"YYYY-MM-DD_HERE", r"\[object Object\]", r"X{2,}(?:项目|公司|先生|女士)",
]
DOUBTFUL = [BRACKETED, r"\?{3,}", r"_{4,}", r"%[sd](?![A-Za-z0-9])", r"\{[^\W\d][\w ]*\}", r"\{\d\}", r"(?<![A-Za-z0-9_])(?:undefined|NaN|TBD)(?![A-Za-z0-9_])", r"某某某?"]

#: What every form begins with or holds: without one of these no text needs the search for the forms.
_FORM_HINT = re.compile(r"\{|<%|@@|%[(A-Zsd]|__|\$[A-Z]|«|&lt;|<[A-Z]{3}|<[\w ]+ (?:goes|erg|einf)|\[|TBD|TODO_|【|[（(](?:此|请)|XX|TT\.|××|YYYY|\?\?\?|undefined|NaN|某某")
_SURE, _DOUBTFUL = re.compile("|".join(SURE)), re.compile("|".join(DOUBTFUL))
_QUOTED = re.compile(r"`[^`\n]+`|\"[^\"\n]+\"|“[^“”\n]+”|„[^„“”\n]+[“”]")
_JSON = re.compile(r"\"\s*[:,}\]]")
_MARKS = re.compile(r"<\|[a-z_]+\|>")
#: Characters that no exemplar has: strays between letters, which come off before words are cut.
_STRAY = re.compile(r"[^\x00-ɏ‘-‟　-〿㐀-鿿！-｝×]+")
_NARROW = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20, 0xA0: 0x20, 0x2019: 0x27}
_LATIN = frozenset(LATIN)
_NOT_LATIN = LIVING - _LATIN
_CONCEPT = {w: c for c, words in reversed(CONCEPTS.items()) for w in words.split()}
_HAN_WORDS = "|".join(sorted((w for w in _CONCEPT if len(w) > 1 and w[0] > "\u3400"), key=lambda w: (-len(w), w)))
_TERM = re.compile(rf"\x01|\x02|[a-zß-ɏ]+(?:'[a-z]+)?|\d+|{_HAN_WORDS}|[㐀-鿿]")
_ASCII_TERM = re.compile(r"\x01|\x02|[a-z]+(?:'[a-z]+)?|\d+")
_PASSAGE = re.compile(r"(?<=[.!?;])\s+|(?<=[。！？；])|[\r\n]+")
_WINDOW = re.compile(_PASSAGE.pattern + r"|</?(?:html|head|title|body|center|h\d|p|noscript|div)\b[^<>\n]*>", re.I)
_AGAIN = re.compile(r"([a-z㐀-鿿]{1,12}?)(?:[ ,.]*(?:\d+ )?\1){2,}")


class _Kinds(dict):
    """The term of each word: its concept, 400 for a status code, 0 for another number, else the word; remembers MOST words."""

    MOST = 1 << 20

    def __missing__(self, word: str) -> str:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = kind = _CONCEPT.get(word, word) if not "0" <= word[0] <= "9" else "400" if len(word) == 3 and word[0] in "45" else "0"
        return kind


_KIND = _Kinds()
_GLUE = frozenset({*(_CONCEPT.get(t, t) for t in LIVING), *COMMON_HAN, *"abcdefghijklmnopqrstuvwxyz0"}) - CONCEPTS.keys()


def _words(low: str) -> list[str]:
    """Words, numbers, Han words and placeholders of a text in lower case, in order."""
    return (_ASCII_TERM if low.isascii() else _TERM).findall(low)


def _terms(window: str, run: int) -> set[str]:
    """The terms of a window: the kinds of its words, but ** if it is mostly one thing again and again, ~~ if it is Latin.

    Latin is what holds no short word of a living language and mostly words that end as Latin ones do.
    """
    low = window.lower()
    words = _words(low)
    unlike = set(words)
    if len(words) >= 3 and 2 * len(unlike) <= len(words) + 1 and (m := _AGAIN.search(low)) and 2 * (m.end() - m.start()) > len(low.strip()):
        return {"**"}
    if len(words) >= run and len(unlike) > 1 and _NOT_LATIN.isdisjoint(unlike) and low.isascii():
        long = [t for t in words if len(t) > 2]
        if long and 10 * sum(t in _LATIN or t.endswith(ENDINGS) for t in long) >= 7 * len(long) and all("a" <= t[0] <= "z" for t in words):
            return {"~~"}
    return {_KIND[t] for t in unlike}


def _bare(text: str) -> str:
    """text with placeholders as \\x01 and \\x02, without marks, strays and what is quoted (but the strings of JSON)."""
    if not text.isascii():
        text = _STRAY.sub("", text)
    if "<|" in text:
        text = _MARKS.sub("", text)
    if "`" in text or '"' in text or "“" in text or "„" in text:
        text = text if '":' in text and _JSON.search(text) else _QUOTED.sub(" \x04 ", text)
    if _FORM_HINT.search(text):
        text = _DOUBTFUL.sub("\x02", _SURE.sub("\x01", text))
    return text if text.isascii() else text.translate(_NARROW)


def windows(text: str) -> list[str]:
    """The passage windows of a text; a line of nothing but a number, as of a status, belongs to that before it, else to the next."""
    out, number = [], ""
    for w in (_WINDOW if "<" in text else _PASSAGE).split(_bare(text)):
        if w and not w.isspace():
            if w.strip().isdecimal():
                if out:
                    out[-1] += f" {w}"
                else:
                    number += f"{w} "
            else:
                out.append(number + w)
                number = ""
    return out


def _exemplar(text: str) -> frozenset[str]:
    marks = {"{}": "\x01", "??": "\x02", "**": "**", "~~": "~~"}
    return frozenset(marks[w] if w in marks else w if w in CONCEPTS or w == "400" else k for w in text.split() for k in ([w] if w in marks or w in CONCEPTS or w == "400" else (_KIND[t] for t in _words(w))))


class Index:
    """The exemplars by the term of theirs that the fewest others have."""

    def __init__(self) -> None:
        made = {(label, _exemplar(t)): None for label, texts in EXEMPLARS.items() for t in texts}
        self.labels, self.terms = [label for label, _ in made], [t for _, t in made]
        self.vocabulary = frozenset().union(*self.terms)
        uses = Counter(t for own in self.terms for t in own)
        self.by: dict[str, list[int]] = defaultdict(list)
        for e, own in enumerate(self.terms):
            self.by[min(own, key=lambda t: (t in _GLUE, uses[t], t))].append(e)
        self.keys = frozenset(self.by)

    def contained(self, own: set[str]) -> list[int]:
        """The exemplars whose terms are all among those of a window; none if all of them are mentions."""
        found = [e for t in own & self.keys for e in self.by[t] if self.terms[e] <= own]
        return found if any(self.labels[e] != "mention" for e in found) else []

    def weigh(self, documents: int, frequency: dict[str, int]) -> None:
        rare = math.log(1 + documents)
        self.weight = {t: math.log(1 + documents / (1 + frequency.get(t, 0))) for t in self.vocabulary}
        # a placeholder weighs more than the rarest word, so that no common frame outweighs it
        self.weight |= {"\x01": 2 * rare, "\x02": rare, "**": rare, "~~": rare}
        self.weight |= {t: min(GLUE, self.weight.get(t, GLUE)) for t in _GLUE}
        self.other = math.log(1 + documents / (1 + documents**0.5))

    def label(self, own: set[str], found: list[int], rule: Coverage) -> str | None:
        """The label of a window of these terms that contains these exemplars, if it is residue."""
        covered: dict[str, set[str]] = defaultdict(set)
        for e in found:
            covered[self.labels[e]] |= self.terms[e]
        if "mention" in covered:
            return None
        whole = sum(self.weight.get(t, self.other) for t in own)
        # a placeholder has its place in any frame: what else stands in its window doesn't tell against it
        shares = [(1.0 if "\x01" in terms else sum(self.weight[t] for t in terms) / whole, label) for label, terms in covered.items()]
        best, name = max(shares)
        return name if best >= rule.explained else None


_index: Index | None = None


def _shared_index() -> Index:
    global _index
    if _index is None:
        _index = Index()
    return _index


def labelled(df: DataFrame, keep: list[str], text: str, rule: Coverage = Coverage()) -> DataFrame:
    """The columns to keep and residue: template, filler, error or script, of the first window that is some; else null.

    One row per row of df; null, empty and blank texts are no residue; texts
    are searched whole. Rows without a key stay. One pass over the texts
    retrieves exemplars and counts in how many texts each of their terms
    stands; weights follow from the counts, which are as many as the
    exemplars have terms, whatever the corpus; only windows that contain an
    exemplar are weighed.
    """
    rows = df.select(*keep, F.col(text).alias("_text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema]
    lists = pa.list_(pa.list_(pa.string()))

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen, n, last = _shared_index(), Counter(), 0, None
        for last in batches:
            out = []
            for t in last.column("_text").to_pylist():
                n += 1
                near, every = [], set()
                for w in windows(t) if t else ():
                    own = _terms(w, rule.run)
                    every |= own
                    if not own.isdisjoint(index.keys) and index.contained(own):
                        near.append(sorted(own))
                seen.update(every & index.vocabulary)
                out.append(near)
            yield pa.RecordBatch.from_arrays([*[last.column(c) for c in keep], pa.array(out, lists), pa.nulls(len(out), pa.string()), pa.nulls(len(out), pa.int64())], [*keep, "near", "term", "n"])
        if n:
            none = [pa.nulls(len(seen) + 1, last.column(c).type) for c in keep]
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(len(seen) + 1, lists), pa.array(["", *seen]), pa.array([n, *seen.values()], pa.int64())], [*keep, "near", "term", "n"])

    made = cut(spread(rows).mapInArrow(retrieve, ", ".join([*fields, "near array<array<string>>", "term string", "n bigint"])))
    counts = {r.term: r.n for r in made.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    documents = counts.pop("", 0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _shared_index()
        index.weigh(documents, counts)
        for b in batches:
            found = [next(filter(None, (index.label(own, index.contained(own), rule) for own in map(set, near))), None) if near else None for near in b.column("near").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(found, pa.string())], [*keep, "residue"])

    return made.filter("term IS NULL").select(*keep, "near").mapInArrow(weigh, ", ".join([*fields, "residue string"]))

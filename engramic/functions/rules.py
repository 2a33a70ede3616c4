"""Rules over texts: noise, retrieval gates, time words, intent, category, value, redaction.

The lists are fixed values; in them `\\b` stands between ASCII word characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramic.functions.text import any_of, bound, java, replaced_if, squeeze, trim

# Patterns, without regard to case.
DENIALS = [r"i don'?t have (any )?(information|data|memory|record)", r"i'?m not sure about", r"i don'?t recall", r"i don'?t remember", r"it looks like i don'?t", r"i wasn'?t able to find", r"no (relevant )?memories found", r"i don'?t have access to"]
META_QUESTIONS = [r"\bdo you (remember|recall|know about)\b", r"\bcan you (remember|recall)\b", r"\bdid i (tell|mention|say|share)\b", r"\bhave i (told|mentioned|said)\b", r"\bwhat did i (tell|say|mention)\b", "如果你知道.+只回复", r"如果不知道.+只回复\s*none", "只回复精确代号", r"只回复\s*none", "你还?记得", "记不记得", "还记得.*吗", "你[知晓]道.+吗", r"我(?:之前|上次|以前)(?:说|提|讲).*(?:吗|呢|？|\?)"]
FRUSTRATION = [r"\byou (never|don'?t|do not|can'?t|cannot) (remember|recall|get|understand)\b", r"\bwhy (do|can) you (keep )?(forget|not remember|never remember)\b", r"\bdid you (get|understand) what i (said|told you|meant)\b", r"^\s*what (just )?changed\??\s*$", r"\bwhy (is|are) (my|the) memor(y|ies) (wrong|missing|broken|not working)\b"]
BOILERPLATE = ["^(hi|hello|hey|good morning|good evening|greetings)", "^fresh session", "^new session", "^HEARTBEAT"]
DIAGNOSTICS = [r"\bquery\s*->\s*(none|no explicit solution|unknown|not found)\b", r"\buser asked for\b.*\b(none|no explicit solution|unknown|not found)\b", r"\bno explicit solution\b"]
FORCED = [r"\b(remember|recall|forgot|memory|memories)\b", r"\b(last time|before|previously|earlier|yesterday|ago)\b", r"\b(my (name|email|phone|address|birthday|preference))\b", r"\b(what did (i|we)|did i (tell|say|mention))\b", r"\b(erinnerst du dich|weißt du noch|weisst du noch|was (war|ist) mein|letzte[sn]?\s+mal|vorher|gestern|neulich)\b", r"\b(merk dir|merke dir|habe ich dir gesagt|habe ich erw[äa]hnt)\b", "(你记得|[你妳]記得|之前|上次|以前|还记得|還記得|提到过|提到過|说过|說過)"]
SKIPPED = [r"^(hi|hello|hey|good\s*(morning|afternoon|evening|night)|greetings|yo|sup|howdy|what'?s up)\b", "^/", r"^(run|build|test|ls|cd|git|npm|pip|docker|curl|cat|grep|find|make|sudo)\b", r"^(yes|no|yep|nope|ok|okay|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|👍|👎|✅|❌)\s*[.!]?$", r"^(go ahead|continue|proceed|do it|start|begin|next|实施|實施|开始|開始|继续|繼續|好的|可以|行)\s*[.!]?$", r"^[0-9#*\x{200D}\x{20E3}\x{2600}-\x{27BF}\x{FE0F}\x{1F000}-\x{1FAFF}\s]+$", "HEARTBEAT", r"^\[System", r"^(ping|pong|test|debug)\s*[.!?]?$"]
DYNAMIC = [r"\btoday\b", r"\byesterday\b", r"\btomorrow\b", r"\brecently\b", r"\bcurrently\b", r"\bright now\b", r"\bthis week\b", r"\bthis month\b", r"\blast week\b", r"\bnext week\b", r"\bthis morning\b", r"\btonight\b", r"\blater\b", "今天", "昨天", "明天", "最近", "正在", "刚才", "刚刚", "这周", "这个月", "上周", "下周", "目前", "现在", "今晚", "今早", "稍后", "待会"]
EXPIRIES = [(["后天", "day after tomorrow"], 48), (["明天", r"\btomorrow\b"], 24), (["下周", r"\bnext week\b"], 168), (["这周", r"\bthis week\b"], 72), (["下个月", r"\bnext month\b"], 720), (["这个月", r"\bthis month\b"], 360), (["今晚", r"\btonight\b"], 12), (["今天", r"\btoday\b"], 18)]
INTENTS = [
    ("preference", "l0", [r"\b(prefer|preference|style|convention|like|dislike|favorite|habit)\b", r"\b(how do (i|we) usually|what('s| is) (my|our) (style|convention|approach))\b", "(偏好|喜欢|习惯|风格|惯例|常用|不喜欢|不要用|别用)"], ["preference", "decision"]),
    ("decision", "l1", [r"\b(why did (we|i)|decision|decided|chose|rationale|trade-?off|reason for)\b", r"\b(what was the (reason|rationale|decision))\b", "(为什么选|决定|选择了|取舍|权衡|原因是|当时决定)"], ["decision", "fact"]),
    ("entity", "l1", [r"\b(who is|who are|tell me about|info on|details about|contact info)\b", r"\b(who('s| is) (the|our|my)|what team|which (person|team))\b", "(谁是|告诉我关于|详情|联系方式|哪个团队)"], ["entity", "fact"]),
    ("event", "full", [r"\b(when did|what happened|timeline|incident|outage|deploy|release|shipped)\b", r"\b(last (week|month|time|sprint)|recently|yesterday|today)\b", "(什么时候|发生了什么|时间线|事件|上线|部署|发布|上次|最近)"], ["entity", "decision"]),
    ("fact", "l1", [r"\b(how (does|do|to)|what (does|do|is)|explain|documentation|spec)\b", r"\b(config|configuration|setup|install|architecture|api|endpoint)\b", "(怎么|如何|是什么|解释|文档|规范|配置|安装|架构|接口)"], ["fact", "entity"]),
]
CATEGORY_HINTS = [
    ("preference", ["prefer|radši|like|love|hate|want|bevorzuge|mag|hasse|will|brauche|偏好|喜歡|喜欢|討厭|讨厌|不喜歡|不喜欢|愛用|爱用|習慣|习惯"]),
    ("decision", ["rozhodli|decided|we decided|will use|we will use|we'?ll use|switch(ed)? to|migrate(d)? to|going forward|from now on|budeme|haben entschieden|ab jetzt|ab sofort|in zukunft|決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用|規則|流程|SOP"]),
    ("entity", [r"\+\d{10,}|@[\w.-]+\.\w+|is called|jmenuje se|mein\s+\w+\s+ist|heißt|我的\S+是|叫我|稱呼|称呼"]),
    ("fact", [r"\b(is|are|has|have|je|má|jsou|ist|sind|hat|habe|wohne|arbeite)\b|immer|niemals|wichtig|總是|总是|從不|从不|一直|每次都|老是"]),
]
TOOL_CALLS = [r"\btool_use\b", r"\btool_result\b", r"\bfunction_call\b", r"\b(memory_store|memory_recall|memory_forget|memory_update)\b"]
CORRECTIONS = [r"^no[,.\s]", r"\bactually\b", r"\binstead\b", r"\bwrong\b", r"\bcorrect(ion)?\b", r"\bfix\b", "不对", "应该是", "應該是", "错了", "錯了", "改成", "不是.*而是"]
DECISIONS = [r"\blet'?s go with\b", r"\bconfirmed?\b", r"\bapproved?\b", r"\bdecided?\b", r"\bwe'?ll use\b", r"\bgoing forward\b", r"\bfrom now on\b", r"\bagreed\b", "决定", "決定", "确认", "確認", "选择了", "選擇了", "就这样", "就這樣"]
ACKNOWLEDGED = [r"^(ok|okay|k|sure|fine|thanks|thank you|thx|ty|got it|understood|cool|nice|great|good|perfect|awesome|alright|yep|yup|yeah|right)\s*[.!]?$", r"^好的?\s*[。！]?$", r"^嗯\s*[。]?$", r"^收到\s*[。！]?$", r"^了解\s*[。！]?$", r"^明白\s*[。！]?$", r"^谢谢\s*[。！]?$", r"^感谢\s*[。！]?$", r"^👍\s*$"]
REMEMBER = [r"\b(remember|recall|don'?t forget|note that|keep in mind)\b", "(记住|記住|别忘|不要忘|记一下|記一下)"]
ERRORS = [r"\[error\]|error:|exception:|fatal:|traceback|syntaxerror|typeerror|referenceerror|npm err!", "command not found|no such file|permission denied|non-zero|exit code", r'"status"\s*:\s*"error"|"status"\s*:\s*"failed"|\biserror\b', r"错误\s*[：:]|异常\s*[：:]|报错\s*[：:]|失败\s*[：:]"]
SECRETS = [r"\bsk-[A-Za-z0-9]{20,}\b", r"\bsk-proj-[A-Za-z0-9\-_]{20,}\b", r"\bsk-ant-[A-Za-z0-9\-_]{20,}\b", r"\bghp_[A-Za-z0-9]{36,}\b", r"\bgho_[A-Za-z0-9]{36,}\b", r"\bghu_[A-Za-z0-9]{36,}\b", r"\bghs_[A-Za-z0-9]{36,}\b", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", r"\bAIza[0-9A-Za-z_-]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"\bnpm_[A-Za-z0-9]{36,}\b", r"(?i)\b(?:token|api[_-]?key|secret|password)\s*[:=]\s*[\"']?[^\s\"',;)}\]]{6,}[\"']?\b", r"-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----[\s\S]*?-----END\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----", r"(?<=://)[^@\s]+:[^@\s]+(?=@)", r"/home/[^\s\"',;)}\]]+", r"/Users/[^\s\"',;)}\]]+", r"[A-Z]:\\[^\s\"',;)}\]]+", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"]
#: What a text must hold for each of these patterns; None where no one literal is sure.
SECRET_MARKS = ["sk-", "sk-proj-", "sk-ant-", "ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "xox", "AIza", "AKIA", "npm_", None, "-----BEGIN", "://", "/home/", "/Users/", ":\\", "@"]
# Words that make no pattern.
STOP_WORDS = ["about", "after", "again", "also", "because", "before", "between", "could", "memory", "should", "their", "there", "these", "those", "through", "using", "where", "which", "while", "would"]
# Groups of words and what they add to a query; the name of one store is left out.
SYNONYMS = [
    (["挂了", "挂掉", "宕机"], ["shutdown", "crashed"], ["崩溃", "crash", "error", "报错", "宕机", "失败"]),
    (["卡住", "卡死", "没反应"], ["hung", "frozen"], ["hang", "timeout", "超时", "无响应", "stuck"]),
    (["炸了", "爆了"], ["oom"], ["崩溃", "crash", "OOM", "内存溢出", "error"]),
    (["配置", "设置"], ["config", "configuration"], ["配置", "config", "configuration", "settings", "设置"]),
    (["部署", "上线"], ["deploy", "deployment"], ["deploy", "部署", "上线", "发布", "release"]),
    (["容器"], ["docker", "container"], ["Docker", "容器", "container", "docker-compose"]),
    (["报错", "出错", "错误"], ["error", "exception"], ["error", "报错", "exception", "错误", "失败", "bug"]),
    (["修复", "修了", "修好"], ["bugfix", "hotfix"], ["fix", "修复", "patch", "解决"]),
    (["踩坑"], ["troubleshoot"], ["踩坑", "bug", "问题", "教训", "排查", "troubleshoot"]),
    (["记忆", "记忆系统"], ["memory"], ["记忆", "memory", "记忆系统", "索引"]),
    (["搜索", "查找", "找不到"], ["search", "retrieval"], ["搜索", "search", "retrieval", "检索", "查找"]),
    (["推送"], ["git push"], ["push", "推送", "git push", "commit"]),
    (["日志"], ["logfile", "logging"], ["日志", "log", "logging", "输出", "打印"]),
    (["权限"], ["permission", "authorization"], ["权限", "permission", "access", "授权", "认证"]),
]
TAG = r"(?i)\b(?:proj|env|team|scope):[\w-]+"
CJK = "[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{AC00}-\\x{D7AF}]"


def is_noise(text: Column) -> Column:
    t = trim(text)
    return (F.length(t) < 5) | any_of(t, DENIALS + META_QUESTIONS + FRUSTRATION + BOILERPLATE + DIAGNOSTICS)


def is_frustration(text: Column) -> Column:
    return any_of(trim(text), FRUSTRATION)


def plain_query(text: Column) -> Column:
    """Without the headers, the job prefix and the time stamp that a host puts before a prompt."""
    s = F.regexp_replace(trim(text), r"(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n", "")
    s = F.regexp_replace(trim(s), r"(?i)^\[cron:[^\]]+\]\s*", "")
    return trim(F.regexp_replace(trim(s), r"^\[[A-Za-z]{3}\s\d{4}-\d{2}-\d{2}\s\d{2}:\d{2}\s[^\]]+\]\s*", ""))


def skips_retrieval(text: Column) -> Column:
    t = plain_query(text)
    short = F.length(t) < F.when(t.rlike(CJK), 6).otherwise(15)
    return ~any_of(t, FORCED) & ((F.length(t) < 5) | any_of(t, SKIPPED) | (short & ~F.contains(t, F.lit("?")) & ~F.contains(t, F.lit("？"))))


def tag_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java(TAG)), F.lit(0))


def temporal_class(text: Column) -> Column:
    return F.when(any_of(text, DYNAMIC), "dynamic").otherwise("static")


def expiry(text: Column, now: Column) -> Column:
    found = F.coalesce(*[F.when(any_of(text, p), F.lit(h * 3_600_000)) for p, h in EXPIRIES])
    return (now + found).cast("long")


def intent(text: Column) -> Column:
    """struct(label, depth, confidence, categories); the first rule that fits decides."""

    def known(label: str, depth: str, confidence: str, categories: list[str]) -> Column:
        named = F.array(*map(F.lit, categories)) if categories else F.array().cast("array<string>")
        return F.struct(F.lit(label).alias("label"), F.lit(depth).alias("depth"), F.lit(confidence).alias("confidence"), named.alias("categories"))

    def first(t: Column) -> Column:
        out = F.when(t == "", known("empty", "l0", "low", []))
        for label, depth, patterns, categories in INTENTS:
            out = out.when(any_of(t, patterns), known(label, depth, "high", categories))
        return out.otherwise(known("broad", "l0", "low", []))

    return bound(trim(text), first)


def category_hint(text: Column) -> Column:
    return F.coalesce(*[F.when(any_of(F.lower(text), p), F.lit(c)) for c, p in CATEGORY_HINTS], F.lit("other"))


def text_value(text: Column) -> Column:
    """struct(score, reason) of a turn."""
    t = trim(text)

    def worth(score: float, reason: str) -> Column:
        return F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))

    return (
        F.when(t == "", worth(0.0, "empty"))
        .when(any_of(t, TOOL_CALLS), worth(1.0, "tool_call"))
        .when(any_of(t, CORRECTIONS), worth(0.95, "correction"))
        .when(any_of(t, DECISIONS), worth(0.85, "decision"))
        .when(any_of(t, ACKNOWLEDGED), worth(0.1, "acknowledgment"))
        .when((F.length(t) > F.when(t.rlike(CJK), 30).otherwise(80)) & t.rlike("^<[a-z-]+>") & t.rlike(r"</[a-z-]+>\s*$"), worth(0.3, "system_xml"))
        .when(F.length(t) > F.when(t.rlike(CJK), 30).otherwise(80), worth(0.7, "substantive"))
        .when(t.rlike("[?？]"), worth(0.5, "short_question"))
        .otherwise(worth(0.4, "short_statement"))
    )


def has_error(text: Column) -> Column:
    return any_of(F.lower(text), ERRORS)


def _with(f: Callable[[Column, str], Column], pattern: str) -> Callable[[Column], Column]:
    return lambda t: f(t, pattern)


def redact(text: Column) -> Column:
    """Bearer tokens keep their word; all other secrets go whole."""
    out = replaced_if(text, "Bearer", r"Bearer\s+[A-Za-z0-9\-._~+/]+=*", "Bearer [REDACTED]")

    def fitting(t: Column, pattern: str) -> Column:
        # word boundaries are slow to look for, so only texts that fit without them are searched with them
        return F.when(t.rlike(pattern.replace(r"\b", "")), F.regexp_replace(t, java(pattern), "[REDACTED]")).otherwise(t)

    for pattern, mark in zip(SECRETS, SECRET_MARKS, strict=True):
        out = replaced_if(out, mark, java(pattern), "[REDACTED]") if mark else bound(out, _with(fitting, pattern))
    return out


def error_signature(text: Column) -> Column:
    s = F.lower(redact(text))
    for held, pattern, mark in [(":\\", r"[a-z]:\\[^ \n\r\t]+", "<path>"), ("/", r"/[^ \n\r\t]+", "<path>"), ("0x", java(r"\b0x[0-9a-f]+\b"), "<hex>")]:
        s = replaced_if(s, held, pattern, mark)
    # digits are word characters, so their boundaries are looked for on one side each
    s = F.regexp_replace(s, "(?<![A-Za-z0-9_])[0-9]++(?![A-Za-z0-9_])", "<n>")
    return F.substring(squeeze(s), 1, 240)


def reason_key(reason: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(reason), r"\d+(?:\.\d+)?", "#"))


def safe_context(text: Column) -> Column:
    """Line ends written out, tags gone, angle brackets full-width, at most 300 characters."""
    s = F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", r"\\n"), "</?[a-zA-Z][^>]*>", "")
    return F.substring(squeeze(F.translate(s, "<>", "＜＞")), 1, 300)


def first_sentence(text: Column, most: int = 80) -> Column:
    """Up to the first sentence end within `most` characters, else cut at a word."""
    end = F.length(F.regexp_extract(text, r"^([\s\S]*?)(?:[.!?]\s|[。！？])", 1))
    cut = F.substring(text, 1, most)
    word = F.regexp_extract(cut, r"^([\s\S]*) ", 1)
    short = F.concat(F.when(F.length(word) > most * 0.6, word).otherwise(cut), F.lit("..."))
    return F.when((end > 0) & (end < most), F.substring(text, F.lit(1), end + 1)).when(F.length(text) <= most, text).otherwise(short)


def tokens(text: Column) -> Column:
    """Han characters one by one, else runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), F.lit(0))


def support_spans(text: Column) -> Column:
    """The distinct lines of a text, and their sentences of four characters or more."""
    lines = F.filter(F.transform(F.split(text, r"\n+"), trim), lambda x: x != "")
    parts = lambda line: F.filter(F.transform(F.split(line, "[。！？!?]+"), trim), lambda x: F.length(x) >= 4)
    return F.array_distinct(F.concat(lines, F.flatten(F.transform(lines, parts))))


def pattern_words(text: Column) -> Column:
    """Words of four characters or more that may make a pattern."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_-]{4,}"), F.lit(0)), lambda w: F.regexp_replace(w, "^[-_]+|[-_]+$", ""))
    return F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))


def expand_query(query: Column, most: int = 5) -> Column:
    """A query with the first additions of the groups that it names."""
    low = F.lower(query)
    none = F.array().cast("array<string>")
    groups = []
    for cn, en, more in SYNONYMS:
        hit = any_of(query, [rf"\b{e}\b" for e in en])
        for c in cn:
            hit = hit | F.contains(low, F.lit(c))
        groups.append(F.when(hit, F.filter(F.array(*map(F.lit, more)), lambda e: ~F.contains(low, F.lower(e)))).otherwise(none))
    added = F.slice(F.array_distinct(F.concat(*groups)), 1, most)
    return F.when((F.length(trim(query)) < 2) | (F.size(added) == 0), query).otherwise(F.concat(query, F.lit(" "), F.array_join(added, " ")))


def at_depth(text: Column, category: Column, scope: Column, depth: str, score: Column) -> Column:
    """A row as one line of a prompt: its first sentence, 300 characters, or all of it."""
    share = F.concat(F.lit(" ("), F.round(score * 100).cast("int").cast("string"), F.lit("%)"))
    if depth == "l0":
        return F.concat(F.lit("- ["), category, F.lit("] "), first_sentence(text), share)
    body = F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 297), F.lit("..."))).otherwise(text) if depth == "l1" else text
    return F.concat(F.lit("- ["), category, F.lit(":"), scope, F.lit("] "), body, share)

"""Rules of what is captured from a conversation, who may write, and whose rows are whose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engramic.functions.rules import CJK
from engramic.functions.text import any_of, squeeze, trim

# Patterns, without regard to case.
TRIGGERS = [
    r"zapamatuj si|pamatuj|remember", "preferuji|radši|nechci|prefer", "rozhodli jsme|budeme používat",
    r"\b(we )?decided\b|we'?ll use|we will use|switch(ed)? to|migrate(d)? to|going forward|from now on", r"\+\d{10,}", r"[\w.-]+@[\w.-]+\.\w+",
    r"můj\s+\w+\s+je|je\s+můj", r"my\s+\w+\s+is|is\s+my", "i (like|prefer|hate|love|want|need|care)", "always|never|important",
    "merk dir|merke dir|erinner dich|vergiss nicht|nicht vergessen", "ich bevorzuge|ich mag|ich hasse|ich will|ich brauche",
    "wir haben entschieden|ab jetzt|ab sofort|in zukunft", r"mein\s+\w+\s+ist|heißt|wohne|arbeite", "immer|niemals|wichtig",
    "記住|记住|記一下|记一下|別忘了|别忘了|備註|备注", "偏好|喜好|喜歡|喜欢|討厭|讨厌|不喜歡|不喜欢|愛用|爱用|習慣|习惯",
    "決定|决定|選擇了|选择了|改用|換成|换成|以後用|以后用", r"我的\S+是|叫我|稱呼|称呼", "老是|講不聽|總是|总是|從不|从不|一直|每次都",
    "重要|關鍵|关键|注意|千萬別|千万别", "幫我|筆記|存檔|存起來|存一下|重點|原則|底線",
]
# Requests about the store itself; names of one program are left out.
EXCLUDED = [
    r"\b(memory_store|memory_recall|memory_forget|memory_update)\b",
    r"\b(delete|remove|forget|purge|cleanup|clean up|clear)\b.*\b(memory|memories|entry|entries)\b",
    r"\b(memory|memories)\b.*\b(delete|remove|forget|purge|cleanup|clean up|clear)\b",
    r"\bhow do i\b.*\b(delete|remove|forget|purge|cleanup|clear)\b", "(删除|刪除|清理|清除).{0,12}(记忆|記憶|memory)",
]
REMEMBER_COMMAND = r"^(?:请|請)?(?:remember(?:\s+this)?|merke?\s+dir|vergiss\s+(?:das\s+)?nicht|记住|記住|记一下|記一下|别忘了|別忘了)[。.!?？！]*$"
EMOJI = r"[\x{1F300}-\x{1F9FF}]"
HEADERS = r"(?im)^(Conversation info|Sender) \(untrusted metadata\):[\s\S]*?\n\s*\n"
# What shows that a reply used what was recalled.
USE_MARKERS = [
    "remember", "之前", "记得", "according to", "based on what", "as you mentioned", "如前所述", "如您所說", "如您所说的", "我記得", "我记得", "之前你說", "之前你说",
    "之前提到", "之前提到的", "根据之前", "依据之前", "按照之前", "照您之前", "照你说的", "from previous", "earlier you", "in the memory", "the memory mentioned", "the memories show",
]
# Beginnings and parts of transcript lines that are never distilled.
NOISE_PREFIXES = ["✅ New session started", "NO_REPLY"]
NOISE_PARTS = ["[queued messages while agent was busy]", "you are running a boot check", "boot.md — gateway startup health check", "read heartbeat.md"]
# Contexts of support, and other names for them.
CONTEXTS = ["general", "morning", "afternoon", "evening", "night", "weekday", "weekend", "work", "leisure", "summer", "winter", "travel"]
CONTEXT_NAMES = {
    "早上": "morning", "上午": "morning", "早晨": "morning", "下午": "afternoon", "傍晚": "evening", "晚上": "evening", "深夜": "night", "夜晚": "night", "凌晨": "night",
    "工作日": "weekday", "平时": "weekday", "周末": "weekend", "假日": "weekend", "休息日": "weekend", "工作": "work", "上班": "work", "办公": "work",
    "休闲": "leisure", "放松": "leisure", "休息": "leisure", "夏天": "summer", "夏季": "summer", "冬天": "winter", "冬季": "winter", "旅行": "travel", "出差": "travel", "旅游": "travel",
}
# Ids that no agent has, and kinds of built-in scopes.
RESERVED = ["system", "undefined"]
BUILT_IN = ["agent:", "custom:", "project:", "user:", "reflection:"]


def capturable(text: Column) -> Column:
    """Whether a turn is worth keeping: of a fair length, not generated, not about the store, and with a trigger."""
    s = F.regexp_replace(trim(text), HEADERS, "")
    n = F.length(s)
    generated = F.contains(s, F.lit("<relevant-memories>")) | (F.startswith(s, F.lit("<")) & F.contains(s, F.lit("</"))) | (F.contains(s, F.lit("**")) & F.contains(s, F.lit("\n-")))
    fair = (n >= F.when(s.rlike(CJK), 4).otherwise(10)) & (n <= 500)
    return fair & ~generated & (F.regexp_count(s, F.lit(EMOJI)) <= 3) & ~any_of(s, EXCLUDED) & any_of(s, TRIGGERS)


def remember_command(text: Column) -> Column:
    return any_of(trim(text), [REMEMBER_COMMAND])


def recall_used(reply: Column) -> Column:
    low = F.lower(reply)
    found = F.lit(False)
    for marker in USE_MARKERS:
        found = found | F.contains(low, F.lit(marker))
    return F.coalesce((F.length(reply) > 24) & found, F.lit(False))


def transcript_noise(text: Column) -> Column:
    """Commands, starts of sessions, boilerplate, dumps and bare code."""
    low = F.lower(text)
    out = (text == "") | F.ltrim(text).startswith("/") | (F.length(text) > 2000)
    for p in NOISE_PREFIXES:
        out = out | text.startswith(p)
    for p in NOISE_PARTS:
        out = out | F.contains(low, F.lit(p))
    return out | (F.startswith(F.trim(text), F.lit("```")) & F.endswith(F.trim(text), F.lit("```")))


def context(label: Column) -> Column:
    low = trim(F.lower(label))
    named = F.try_element_at(F.create_map(*[F.lit(x) for p in CONTEXT_NAMES.items() for x in p]), low)
    return F.when(F.coalesce(low, F.lit("")) == "", F.lit("general")).otherwise(F.coalesce(F.when(low.isin(CONTEXTS), low), named, low))


def support_updated(slices: Column, label: Column, supports: Column, at: Column, most: int = 8) -> Column:
    """struct(global_strength, total_observations, slices) after one observation in a context.

    ``slices`` is an array of struct(context, confirmations, contradictions, last_observed_at). The
    ``most`` newest contexts stay; the evidence of the others still counts in the total.
    """
    ctx = context(label)
    yes, no = supports.cast("long"), (~supports).cast("long")

    def seen(s: Column) -> Column:
        hit = s.context == ctx
        return F.struct(
            s.context.alias("context"),
            (s.confirmations + F.when(hit, yes).otherwise(0)).alias("confirmations"),
            (s.contradictions + F.when(hit, no).otherwise(0)).alias("contradictions"),
            F.when(hit, at).otherwise(s.last_observed_at).alias("last_observed_at"),
        )

    new = F.array(F.struct(ctx.alias("context"), yes.alias("confirmations"), no.alias("contradictions"), at.alias("last_observed_at")))
    every = F.when(F.exists(slices, lambda s: s.context == ctx), F.transform(slices, seen)).otherwise(F.concat(slices, new))
    total = lambda f: F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + s[f])
    good, all_ = total("confirmations"), total("confirmations") + total("contradictions")
    newest = F.array_sort(F.transform(every, lambda s: F.struct((-s.last_observed_at).alias("o"), s.alias("s"))))
    kept = F.transform(F.slice(newest, 1, most), lambda x: x.s)
    return F.struct(F.when(all_ > 0, good / all_).otherwise(0.5).alias("global_strength"), all_.alias("total_observations"), kept.alias("slices"))


def agent_of_session(key: Column) -> Column:
    """The agent id of ``agent:<id>[:...]``; null for other keys and reserved ids."""
    named = F.nullif(trim(F.regexp_extract(trim(key), r"(?s)^agent:([^:]*)", 1)), F.lit(""))
    return F.when(~named.isin(RESERVED), named)


def invalid_agent(agent: Column, declared: list[str] | None = None) -> Column:
    bad = (F.coalesce(trim(agent), F.lit("")) == "") | agent.rlike("^[0-9]+$")
    return bad | (~agent.isin(declared) if declared else F.lit(False))


def excluded_agent(agent: Column, session: Column, patterns: list[str]) -> Column:
    """By its id, by a beginning that ends in ``-``, or, with ``temp:*``, as an internal reflection session."""
    a = trim(agent)
    hit = F.lit(False)
    for p in (x.strip() for x in patterns):
        if p == "temp:*":
            hit = hit | F.coalesce(trim(session).startswith("temp:memory-reflection"), F.lit(False))
        elif p:
            hit = hit | (a.startswith(p) if p.endswith("-") else a == p)
    return F.coalesce((a != "") & hit, F.lit(False))


def valid_scope(scope: Column, defined: list[str]) -> Column:
    s = trim(scope)
    ok = (s == "global") | s.isin(defined)
    for kind in BUILT_IN:
        ok = ok | s.startswith(kind)
    return F.coalesce(ok, F.lit(False))


def scope_parts(scope: Column) -> Column:
    """struct(type, id) of ``type:id``; the global scope has an empty id, other scopes without a colon are null."""
    at = F.instr(scope, ":")
    return F.when(scope == "global", F.struct(scope.alias("type"), F.lit("").alias("id"))).when(at > 0, F.struct(F.substring(scope, F.lit(1), at - 1).alias("type"), F.substring(scope, at + 1, F.length(scope)).alias("id")))


def scope_kind(scope: Column) -> Column:
    """The kind under which a scope is counted; reflections count as users'."""
    out = F.when(scope == "global", F.lit("global"))
    for kind in ("agent", "custom", "project", "user"):
        out = out.when(scope.startswith(f"{kind}:"), F.lit(kind))
    return out.when(scope.startswith("reflection:"), F.lit("user")).otherwise(F.lit("other"))


def accessible_scopes(agent: Column, access: dict[str, list[str]]) -> Column:
    """A listed agent's scopes, else the global and its own one; always with its own reflections."""
    a = trim(agent)
    own = F.array(F.lit("global"), F.concat(F.lit("agent:"), a))
    listed = F.lit(None).cast("array<string>")
    for name, scopes in access.items():
        listed = F.when(a == name, F.array(*map(F.lit, scopes)) if scopes else F.array().cast("array<string>")).otherwise(listed)
    return F.array_union(F.coalesce(listed, own), F.array(F.concat(F.lit("reflection:agent:"), a)))


def extraction_policy(scope: Column, policy: dict[str, str]) -> Column:
    """The mode of a scope: by its name, else by the first pattern with ``*`` that fits, else full."""
    out = F.when(F.lit(False), F.lit(""))
    for name, mode in policy.items():
        out = out.when(scope == name, F.lit(mode))
    for name, mode in policy.items():
        if "*" in name:
            out = out.when(scope.rlike("^" + ".*".join("\\Q" + p + "\\E" for p in name.split("*")) + "$"), F.lit(mode))
    return out.otherwise(F.lit("full"))


def owned_by(owner: Column, kind: Column, kind_is_text: Column, agent: str) -> Column:
    """Exact owners only; a kind that is present, but not text, belongs to nobody."""
    return F.coalesce((kind.isNull() | kind_is_text) & (trim(owner) == agent) & (trim(owner) != ""), F.lit(False))


def inline(text: Column) -> Column:
    return squeeze(text)

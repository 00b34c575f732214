"""Text expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no keywords.
STOP_WORDS = (
    "the a an of to in on for with at by from as is was are were be been being have has had do does did will would could should may might must can "
    "this that these those i you he she it we they what which who whom how when where why not no yes and or but if then so because although while "
    "的 了 是 在 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 那 什么 怎么 如何 为什么 吗 呢 吧 啊"
).split()
# What separates keywords.
KEYWORD_BREAKS = r"""[\s\-_.,;:'"()（）【】《》\[\]{}!?~`#$%^&*+=|\\/<>]+"""
# Messages that carry nothing. First those found anywhere, then those at the start.
DENIALS = (
    r"(?i)i don'?t have (any )?(information|data|memory|record)", r"(?i)i'?m not sure about", r"(?i)i don'?t recall", r"(?i)i don'?t remember",
    r"(?i)it looks like i don'?t", r"(?i)i wasn'?t able to find", r"(?i)no (relevant )?memories found", r"(?i)i don'?t have access to",
    r"我没有(任何)?(相关)?(信息|数据|记忆|记录)", r"我不(太)?确定", r"我不记得", r"我想不起来", r"我没(有)?找到", r"找不到(相关)?记忆", r"没有(相关)?记忆", r"我无法(访问|获取)",
)
META_QUESTIONS = (
    r"(?i)\bdo you (remember|recall|know about)\b", r"(?i)\bcan you (remember|recall)\b", r"(?i)\bdid i (tell|mention|say|share)\b", r"(?i)\bhave i (told|mentioned|said)\b", r"(?i)\bwhat did i (tell|say|mention)\b",
    r"你(还)?记得吗", r"你(还)?记不记得", r"你知道我(说过|提过|告诉|提到).*吗", r"我(有没有|是不是)(说过|提过|告诉|提到)", r"我之前(说过|提过|提到|告诉)", r"我(跟你)?说过.*吗",
)
GREETINGS = (
    r"(?i)^(hi|hello|hey|good morning|good evening|greetings|yo|sup|howdy)", r"(?i)^fresh session", r"(?i)^new session", r"(?i)^HEARTBEAT",
    r"^你好[!！\s,.，。]?$", r"^(早上好|早安|午安|晚上好|晚安)[!！\s,.，。]?$", r"^(嗨|哈[喽啰]|哈[喽啰]呀)[!！\s,.，。]?$", r"^新(会话|对话|聊天)",
)
SHORT_ACKS = (r"(?i)^(好的|好吧|行|可以|没问题|ok|ok|收到|明白|了解|知道了)", r"(?i)^(谢谢|感谢|多谢|谢啦|3q|thx)")
SHORT_ACK_LENGTH = 10
CHARS_PER_TOKEN = 3


def strip(c: Column) -> Column:
    """Without white space at both ends, that of Unicode and a byte order mark included."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def normalized_name(c: Column) -> Column:
    """Lower-case words of a-z, 0-9 and CJK, joined by single hyphens."""
    c = F.regexp_replace(F.lower(strip(c)), r"[\s_]+", "-")
    c = F.regexp_replace(c, r"[^a-z0-9一-鿿\-]", "")
    return F.regexp_replace(F.regexp_replace(c, "-{2,}", "-"), "^-|-$", "")


def keywords(query: Column) -> Column:
    """Distinct words of more than one character that are neither stop words nor numbers."""
    words = F.split(F.lower(query), KEYWORD_BREAKS)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.char_length(w) > 1) & ~F.array_contains(stop, w) & ~w.rlike("^[0-9]+$")))


def node_text(content_chars: int) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("description", F.lit("")), F.substring(F.coalesce("content", F.lit("")), 1, content_chars)))


def keyword_hit(words: Column, text: Column) -> Column:
    """1.0 if any keyword occurs in the text, else 0.0."""
    return F.when(F.exists(words, lambda w: F.contains(text, w)), 1.0).otherwise(0.0)


def keyword_overlap(words: Column, text: Column) -> Column:
    """The share of keywords that occur in the text."""
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return F.when(F.size(words) > 0, hits / F.size(words)).otherwise(0.0)


def is_noise(c: Column) -> Column:
    text = strip(c)
    long_ones = reduce(lambda a, b: a | b, [text.rlike(p) for p in DENIALS + META_QUESTIONS + GREETINGS])
    short_ones = reduce(lambda a, b: a | b, [text.rlike(p) for p in SHORT_ACKS])
    return (F.char_length(text) < 3) | long_ones | ((F.char_length(text) <= SHORT_ACK_LENGTH) & short_ones)


def escaped(c: Column, apostrophes: bool = False) -> Column:
    """For XML; one renderer escapes apostrophes too."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *([("'", "&apos;")] if apostrophes else [])):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def tokens(chars: Column) -> Column:
    return F.ceil(chars / F.lit(CHARS_PER_TOKEN)).cast("long")


def shortened(c: Column, most: int, note: str = "\n...(truncated {} chars)") -> Column:
    """The first characters, and how many were cut."""
    before, after = note.split("{}")
    return F.when(F.char_length(c) > most, F.concat(F.substring(c, 1, most), F.lit(before), (F.char_length(c) - most).cast("string"), F.lit(after))).otherwise(c)


def without_memory_block(c: Column, tag: str = "memory") -> Column:
    """Without a leading injected block <tag>...</tag>."""
    return strip(F.regexp_replace(strip(c), rf"(?is)^<{tag}>.*?</{tag}>", ""))


def clean_prompt(c: Column) -> Column:
    """Without a sender's metadata, a leading /command and a leading [stamp]."""
    text = strip(c)
    marked = F.contains(text, F.lit("Sender (untrusted metadata)"))
    fenced = strip(F.regexp_replace(text, r"(?s)^.*?```json.*?```", ""))
    cut = F.when(text.rlike(r"(?s)```json.*```"), fenced).otherwise(text)
    lines = F.filter(F.split(cut, "\n"), lambda x: (strip(x) != "") & ~F.contains(x, F.lit("Sender")) & ~x.startswith("```") & ~x.startswith("{"))
    still = F.contains(cut, F.lit("Sender (untrusted metadata)"))
    text = F.when(marked, F.when(still, strip(F.array_join(lines, "\n"))).otherwise(cut)).otherwise(text)
    text = strip(F.regexp_replace(text, r"^/\w+\s+", ""))
    return strip(F.regexp_replace(text, r"^\[[\w\s\-:]+\]\s*", ""))


def user_text(c: Column, tag: str = "memory") -> Column:
    """What the user wrote, without metadata, an injected block, a command or a stamp."""
    last = strip(F.substring_index(c, "```", -1))
    text = F.when(F.contains(c, F.lit("```")) & F.contains(c, F.lit("Sender")), last).otherwise(c)
    text = without_memory_block(text, tag)
    text = strip(F.regexp_replace(text, r"^/\w+\s+", ""))
    return strip(F.regexp_replace(text, r"^\[[\w\s\-:]+\]\s*", ""))


def text_blocks(blocks: Column) -> Column:
    """The text blocks of a message (array of structs type, text), joined by newlines."""
    return strip(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n"))


def prepended(c: Column, prefix: Column) -> Column:
    return F.when(strip(prefix) == "", c).otherwise(F.concat(prefix, F.lit("\n\n"), c))


def json_part(c: Column) -> Column:
    """The JSON object of a model's answer: without thoughts and fences, from the first "{" to the
    last "}" unless it is wholly one value."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*", "")
    s = strip(F.regexp_replace(F.regexp_replace(s, r"(?i)^```(?:json)?\s*\n?", ""), r"(?i)\n?\s*```\s*$", ""))
    whole = (s.startswith("{") & s.endswith("}")) | (s.startswith("[") & s.endswith("]"))
    inner = F.regexp_extract(s, r"(?s)\{.*\}", 0)
    return F.when(whole | (inner == ""), s).otherwise(inner)


def prompt_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def fingerprint(role: Column, content: Column, tool_call_id: Column, name: Column, tag: str = "memory") -> Column:
    """Equal for messages that say the same."""
    value = F.struct(F.coalesce(role, F.lit("unknown")).alias("role"), without_memory_block(content, tag).alias("content"), tool_call_id.alias("tool_call_id"), name.alias("name"))
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def chat_type(key: Column, provider: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    explicit = k.startswith("agent:") & (F.get(F.split(k, ":"), 2) == "explicit")
    kind = F.when(F.contains(k, F.lit(":group:")), "group").when(F.contains(k, F.lit(":channel:")), "channel").when(F.contains(k, F.lit(":direct:")) | F.contains(k, F.lit(":dm:")), "direct")
    return kind.when(explicit, "explicit").when(F.lower(F.trim(F.coalesce(provider, F.lit("")))) == "webchat", "direct").when(k != "", "explicit")


def conversation_id(key: Column) -> Column:
    """What follows the marker of the chat's kind, else the whole key; a thread's suffix goes."""
    base = F.regexp_replace(F.trim(key), r"(?i):thread:[^:]+$", "")
    after = F.regexp_extract(base, r"(?is)^(?:(?!(?:direct|dm|group|channel):)[^:]*:)*(?:direct|dm|group|channel):(.*)$", 1)
    marked = base.rlike(r"(?i)(^|:)(direct|dm|group|channel):")
    out = F.lower(F.trim(F.when(marked, after).otherwise(base)))
    return F.when(F.trim(key) != "", F.when(out != "", out))


def agent_id(key: Column) -> Column:
    parts = F.split(F.coalesce(key, F.lit("")), ":")
    return F.when((F.get(parts, 0) == "agent") & (F.get(parts, 1) != ""), F.get(parts, 1)).otherwise("main")

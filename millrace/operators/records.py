"""Conversations as records: an array of messages in turn order, and checks on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T

# Tokens of other formats that must not stand in a message.
ARTEFACTS = (r"(?i)<\|im_start\|>", r"(?i)<\|im_end\|>", r"(?i)<\|endoftext\|>", r"(?i)<unk>", r"\[INST\]|\[/INST\]", r"<s>|</s>")


def from_turns(turns: DataFrame) -> DataFrame:
    """conv_id and messages(role, content) from one row per turn; memory per row is one conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.col("role"), F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(ordered.alias("_m")).select("conv_id", F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def of_role(messages: Column, role: str) -> Column:
    """Contents of one role in order."""
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: m["content"])


def content_hash(messages: Column) -> Column:
    """sha256 over content and role of every message, white space collapsed."""
    parts = F.transform(messages, lambda m: F.concat(T.collapse(m["content"]), F.lit("\x1f"), m["role"]))
    return F.sha2(F.array_join(parts, "\x1e").cast("binary"), 256)


def prompt_hash(messages: Column) -> Column:
    """sha256 of the user turns, white space collapsed."""
    return F.sha2(T.collapse(F.array_join(of_role(messages, "user"), " ")).cast("binary"), 256)


def flow_error(messages: Column) -> Column:
    """Null if the turns follow the rules, else the first rule broken."""
    roles = F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: m["role"])
    pairs = F.zip_with(F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))), F.slice(roles, 2, F.greatest(F.size(roles) - 1, F.lit(0))), lambda a, b: a == b)
    return (
        F.when(F.size(messages) == 0, "empty")
        .when(F.size(roles) == 0, "system_only")
        .when(roles[0] != "user", "first_not_user")
        .when(F.exists(pairs, lambda same: same), "repeated_role")
    )


def message_problem(content: Column, shortest: int = 10, longest: int = 65_536) -> Column:
    """First rule that a message breaks, else null."""
    bare = T.strip(F.coalesce(content, F.lit("")))
    out = F.when(bare == "", "empty_message").when(F.length(bare) < shortest, "excessively_short").when(F.length(content) > longest, "excessively_long").when(content.rlike("[�\\x00]"), "corrupted_unicode")
    for pattern in ARTEFACTS:
        out = out.when(content.rlike(pattern), "formatting_artifact")
    return out


def rejection(messages: Column) -> Column:
    """Reason to reject a record: first message, then first rule; then the turn rules."""
    problems = F.filter(F.transform(messages, lambda m: message_problem(m["content"])), lambda p: p.isNotNull())
    return F.when(F.size(messages) == 0, "empty_record").when(F.size(problems) > 0, F.get(problems, F.lit(0))).when(flow_error(messages).isNotNull(), "schema_error")


def chat_template(messages: Column) -> Column:
    """The messages in chat markup."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")


def prompt_and_completion(messages: Column) -> Column:
    """Struct of prompt (all but the last message) and completion (the last, which must be the assistant's), else null."""
    last = F.element_at(messages, -1)
    prompt = F.array_join(F.transform(F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0))), lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return F.when((F.size(messages) > 1) & (last["role"] == "assistant"), F.struct(prompt.alias("prompt"), last["content"].alias("completion")))


# The keys of the five shapes in which records come.
SHAPES = "messages array<struct<role string, content string>>, conversations array<struct<`from` string, role string, value string, content string>>, prompt string, response string, system string, instruction string, input string, output string, question string, answer string"


def adapt(raw: Column) -> Column:
    """Messages (role, content) of a record in JSON, by the first shape whose keys are filled:
    messages, conversations, prompt and response (with system), instruction (with input) and output, question and answer.

    Roles are mapped and contents normalised; no known shape, or no JSON, gives no messages.
    """

    def clean(text):
        return T.trim_lines(T.plain_lines(F.coalesce(text, F.lit(""))))

    def message(role, content):
        return F.struct(role.alias("role"), content.alias("content"))

    user, assistant = F.lit("user"), F.lit("assistant")

    def read(r):
        task = F.when(clean(r["input"]) != "", F.concat(clean(r["instruction"]), F.lit("\n\n"), clean(r["input"]))).otherwise(clean(r["instruction"]))
        pair = lambda a, b: F.array(message(user, a), message(assistant, b))
        systems = F.when(F.coalesce(r["system"], F.lit("")) != "", F.array(message(F.lit("system"), clean(r["system"])))).otherwise(F.slice(pair(F.lit(""), F.lit("")), 1, 0))
        return (
            F.when(r["messages"].isNotNull(), F.transform(r["messages"], lambda m: message(T.role(m["role"]), clean(m["content"]))))
            .when(r["conversations"].isNotNull(), F.transform(r["conversations"], lambda m: message(T.role(F.coalesce(m["from"], m["role"])), clean(F.coalesce(m["value"], m["content"])))))
            .when(r["prompt"].isNotNull() & r["response"].isNotNull(), F.concat(systems, pair(clean(r["prompt"]), clean(r["response"]))))
            .when(r["instruction"].isNotNull() & r["output"].isNotNull(), pair(task, clean(r["output"])))
            .when(r["question"].isNotNull() & r["answer"].isNotNull(), pair(clean(r["question"]), clean(r["answer"])))
            .otherwise(F.slice(pair(F.lit(""), F.lit("")), 1, 0))
        )

    return T.let(F.from_json(raw, SHAPES), read)


def label_array(messages: Column, ignored: int = -100) -> Column:
    """Labels of the words of the chat markup: what an assistant says, with its end mark, by crc32 of the word; all else ``ignored``."""

    def of(m):
        said = F.concat(T.words(m["content"]), F.array(F.lit("<|im_end|>")))
        return F.concat(F.array(F.lit(ignored).cast("long")), F.transform(said, lambda w: F.when(m["role"] == "assistant", F.crc32(w.cast("binary"))).otherwise(ignored)))

    return F.flatten(F.transform(messages, of))

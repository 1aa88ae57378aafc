from citeflow.functions.chat import conversation, prompt, render_chat, user_side
from citeflow.functions.hashing import hash_slot, seeded_hash
from citeflow.functions.names import field_or_name, first_nonempty, parse_name_list, split_judges
from citeflow.functions.text import (
    collapse_ws,
    keep_last_words,
    preview,
    strip_ws,
    tag_format,
    with_instruction,
    word_count,
    words,
)
from citeflow.functions.vectors import dot, l2_normalise

__all__ = [
    "collapse_ws",
    "conversation",
    "dot",
    "field_or_name",
    "first_nonempty",
    "hash_slot",
    "keep_last_words",
    "l2_normalise",
    "parse_name_list",
    "preview",
    "prompt",
    "render_chat",
    "seeded_hash",
    "split_judges",
    "strip_ws",
    "tag_format",
    "user_side",
    "with_instruction",
    "word_count",
    "words",
]

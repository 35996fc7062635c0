from lexlab.functions.exprs import (  # noqa: F401
    argmax, dot, format_scores, half_up_pct2, invert_map, map_literal, safe_div,
    scores_map, seeded_md5, softmax, split_last, strip_ws, unit_interval,
)
from lexlab.functions.text import (  # noqa: F401
    char_ngrams, token_index, token_indices, truncate, word_tokens,
)

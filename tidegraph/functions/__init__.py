from tidegraph.functions.columns import (
    CLOCK_STEP,
    CONTACT_STEP,
    HOP_STEP,
    checkpoint_tick,
    last_pos,
    seen_at,
    triplet_text,
)

__all__ = [
    "CLOCK_STEP",
    "CONTACT_STEP",
    "HOP_STEP",
    "checkpoint_tick",
    "last_pos",
    "seen_at",
    "triplet_text",
]

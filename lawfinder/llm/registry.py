"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from lawfinder.llm.decontamination import OP5_SQL, op5_decontaminate
from lawfinder.llm.html import op1_html
from lawfinder.llm.linededup import OP4_SQL, op4_line_dedup
from lawfinder.llm.media import op7_media
from lawfinder.llm.mixing import OP8_SQL, op8_mix
from lawfinder.llm.quality import op10_quality
from lawfinder.llm.sharding import op9_shard
from lawfinder.llm.simhash import op6_simhash
from lawfinder.llm.toxicity import op3_toxicity
from lawfinder.llm.warc import OP2_SQL, op2_warc


def queries() -> dict:
    return {
        "op1_html": op1_html,
        "op2_warc": op2_warc,
        "op3_toxicity": op3_toxicity,
        "op4_line_dedup": op4_line_dedup,
        "op5_decontaminate": op5_decontaminate,
        "op6_simhash": op6_simhash,
        "op7_media": op7_media,
        "op8_mix": op8_mix,
        "op9_shard": op9_shard,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_decontaminate": OP5_SQL, "op8_mix": OP8_SQL}

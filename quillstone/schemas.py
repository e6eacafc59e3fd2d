"""Types of the thirteen tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D, B, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
BOX = T.StructType([T.StructField(n, D) for n in ("x", "y", "width", "height")])
NAMES = T.MapType(S, S)


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


HYPOTHESIS = _table(text=S, normalized_text=S, visual=D, variant=S, model=S, family=S, safe_edit=B)

TABLES = {
    "documents": _table(id=S, source_artifact_id=S, filename=S, media_type=S, status=S, page_count=I, error_message=S, created_at=TS, metadata=S),
    "jobs": _table(id=S, document_id=S, status=S, stage=S, progress=D, message=S, error_message=S, created_at=TS, updated_at=TS),
    "artifacts": _table(id=S, sha256=S, media_type=S, path=S, transformation_name=S, source_artifact_id=S, page_id=S, document_id=S, settings=S, created_at=TS),
    "pages": _table(id=S, document_id=S, page_index=I, width=I, height=I, blur=D, contrast=D, noise=D, skew=D, resolution=D, quality_class=S, artifact_ids=NAMES),
    "regions": _table(id=S, page_id=S, region_type=S, bbox=BOX, confidence=D, linked_region_id=S, metadata=S),
    "lines": _table(id=S, page_id=S, region_id=S, reading_order=I, bbox=BOX, polygon=T.ArrayType(T.ArrayType(D)), crop_artifact_ids=NAMES, is_crossed_out_candidate=B, crossed_out_score=D, script_mode=S, stroke_irregularity=D, print_text=S, print_score=D, strike_uncertain=B, htr_blocked=B, routing_uncertain=B),
    "recognition_runs": _table(id=S, document_id=S, line_id=S, model_name=S, model_version=S, image_variant=S, configuration=S, started_at=TS, finished_at=TS),
    "hypotheses": _table(id=S, line_id=S, recognition_run_id=S, text=S, normalized_text=S, rank=I, sequence_score=D, visual_score=D, model_name=S, model_version=S, source_crop_id=S, image_variant=S, token_confidences=T.ArrayType(D), family=S, safe_edit=B),
    "word_evidence": _table(id=S, document_id=S, page_id=S, line_id=S, reading_order=I, text=S, decision_state=S, confidence=D, uncertainty=D, final_score=D, alternatives=T.ArrayType(S), evidence_ids=T.ArrayType(S), region_type=S, is_high_risk=B, bbox=BOX, score_breakdown=T.MapType(S, D), updated_at=TS),
    "decisions": _table(id=S, word_evidence_id=S, state=S, reason=S, confidence=D, thresholds_used=T.MapType(S, D), created_at=TS),
    "review_tasks": _table(id=S, word_evidence_id=S, reason=S, priority=I, created_at=TS),
    "corrections": _table(id=S, word_evidence_id=S, previous_text=S, new_text=S, previous_state=S, new_state=S, actor=S, created_at=TS),
    "audit_events": _table(id=S, document_id=S, event_type=S, payload=S, created_at=TS),
}
KEYS = {name: ["id"] for name in TABLES}

"""Struct types of the working tables."""

from __future__ import annotations

# Hot columns taken from a structured log record; anything else stays in the VARIANT ``raw``.
LOG_FIELDS = {
    "level": "string",
    "request_id": "string",
    "job_id": "string",
    "method": "string",
    "path": "string",
    "route": "string",
    "status_code": "int",
    "ok": "boolean",
    "duration_ms": "bigint",
    "total_processing_ms": "bigint",
    "status": "string",
    "rice_detected": "boolean",
    "grain_count": "bigint",
    "whole_count": "bigint",
    "broken_count": "bigint",
    "undetermined_count": "bigint",
    "reference_source": "string",
    "segmentation_method": "string",
    "filename": "string",
    "failed_stage": "string",
    "error_type": "string",
    "error_message": "string",
    "process_id": "bigint",
    "rss_mb": "double",
}

PROFILE = (
    "profile_name string, reference_unit string, whole_kernel_length double, whole_kernel_breadth double, "
    "whole_kernel_lb_ratio double, source string, reference_count int, notes string, data_status string, "
    "production_eligible boolean, variety string, measurement_method string, measurement_date string, "
    "operator string, sample_identifier string"
)

BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
POINTS = "array<struct<x:double,y:double>>"
LIMIT = "struct<max_percent:double,basis:string,sub_limits:map<string,struct<max_percent:double,basis:string>>>"
ASSESSMENT = "image_assessable string, image_basis string, limitation string"

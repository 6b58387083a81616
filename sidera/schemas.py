"""Schemas of the tables that come from outside."""

from __future__ import annotations

META = "parent_asin string, main_category string, title string, average_rating float, rating_number int, features array<string>, description array<string>, price float, store string, categories array<string>"
RATINGS = "user_id string, parent_asin string, rating double, timestamp bigint"
SEMANTIC_IDS = "parent_asin string, A smallint, B smallint, C smallint, D smallint, sid_tokens string"
CLEAN_LOG = "parent_asin string, clean_title string, clean_description string, clean_features array<string>, error string"
PREDICTIONS = "task string, sample_id bigint, gold struct<A:string,B:string,C:string,D:string>, beams array<struct<A:string,B:string,C:string,D:string>>"

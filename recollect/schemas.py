"""Schemas of the data model, as Spark DDL."""

PAGE = "page_id string, source_id string, slug string, title string, perturbations array<string>"
CHUNK = "chunk_id string, page_id string, chunk_index int, text string, embedding array<float>"
LINK = "source_page_id string, target_page_id string, link_type string, provenance string"
MANIFEST = (
    "schema_version int, corpus_id string, content_hash string, embedding_model string, embedding_dimensions int, "
    "chunker_version string, counts map<string,bigint>, artifact_hashes map<string,string>"
)
QUERY = "query_id string, query_text string, top_k int"
SEED = "seed_id string, surface string, normalized_surface string, source string, span_start int, span_end int, matched_page_ids array<string>"
SOURCE = "struct<source_id:string,path:string,sha256:string,perturbations:array<string>>"
CASE = (
    "case_id string, base_case_id string, variant string, prompt string, "
    "observation struct<kind:string,content_path:string,replacements:array<struct<old:string,new:string>>>, "
    "cue struct<present:boolean,text:string,type:string,query:string>, "
    f"memory struct<corpus_id:string,text:string,gold_source_ids:array<string>,sources:array<{SOURCE}>,sensitive_terms:array<string>>, "
    "decisions struct<answer_type:string,output_only:struct<choice:string>,memory_conditioned:struct<choice:string>>, "
    "distractors struct<sources:array<struct<source_id:string,text:string,perturbations:array<string>>>>, "
    "provenance struct<example_number:int,approved:boolean>"
)
PREDICTION = (
    "case_id string, baseline string, output_rag_flow string, response_text string, requested_model string, resolved_model string, "
    "usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, truncated boolean, "
    "trace struct<retrieved_page_ids:array<string>,admitted_page_ids:array<string>,admitted_source_ids:array<string>,admitted_perturbations:map<string,array<string>>>"
)
EXPANSION = "query_hash string, normalized_query string, model string, prompt_version string, alternatives array<string>"
RESPONSE = "request_hash string, model string, text string, response_id string, resolved_model string"

VARIANTS = ("positive", "cue-ablated", "memory-included")
OBSERVATION_KINDS = ("tool_result", "assistant_output")

"""Schemas of the catalog's tables, and the grammar of ids."""

from __future__ import annotations

import re

RECT = "struct<x:double,y:double,w:double,h:double>"
VIEWPORT = "struct<name:string,w:double,h:double,dpr:double>"
TABLES: dict[str, str] = {
    "pages": "id string, url string, title string, discovered_via array<string>, load_status string, ax_tree_ref struct<root_ax_id:string,provenance:string>, "
    "viewport struct<w:double,h:double,dpr:double>, screenshot_ref string, canonical_url string, crawled_at string, parent_page_id string, seq bigint",
    "ax": "id string, page_id string, role string, name string, name_source string, "
    "states struct<expanded:boolean,disabled:boolean,pressed:boolean,selected:boolean,checked:boolean,busy:boolean,open:boolean,current:string>, "
    "properties struct<controls:array<string>,described_by:array<string>,labelled_by:array<string>,level:double,pos_in_set:double,set_size:double,value_now:double,value_min:double,value_max:double,live:string,orientation:string,value_text:string>, "
    "apg_pattern string, focusable boolean, visibility string, in_page_dom_order int, parent_ax_id string, provenance string, seq bigint",
    "visual": f"id string, ax_id string, page_id string, rect {RECT}, style map<string,string>, refs array<string>, "
    "tethers struct<parent:string,children:array<string>,siblings_before:array<string>,siblings_after:array<string>,anchors:array<struct<name:string,target:string>>>, "
    f"viewport {VIEWPORT}, is_visual_container boolean, container_type string, box_sizing string, padding_box {RECT}, is_scroll_container boolean, is_stacking_context boolean, z_index int, has_transform boolean, "
    "occlusion struct<visible_ratio:double,is_occluded boolean,is_offscreen:boolean>".replace("is_occluded boolean", "is_occluded:boolean") + ", "
    "patterns array<struct<pattern:string,confidence:double>>, primary_pattern string, bindings array<string>, drift_severities array<string>, provenance string, seq bigint",
    "observations": f"ax_id string, vp_key string, viewport {VIEWPORT}, rect {RECT}, style map<string,string>, visibility string, crawled_at string, seq bigint",
    "nav": "id string, page_id string, kind string, in_page_dom_order int, container_ax_id string, member_ax_ids array<string>, active_member_ax_id string, name string, seq bigint",
    "edges": "id string, src string, dst string, kind string, provenance string, spatial struct<distance:double,overlap:double>, triggers array<string>, "
    "cause struct<source_ax_id:string,declared_kind:string,command_value:string,option_value:string>, href_value string, seq bigint",
    "capabilities": "id string, name string, description string, input_schema string, output_schema string, source string, binding struct<kind:string,ax_id:string,selector:string>, security string, provenance string, page_id string, seq bigint",
    "transitions": "id string, kind string, trigger string, from_ax_id string, to_ax_ids array<string>, before_snapshot string, after_snapshot string, apg_pattern string, preconditions array<string>, provenance string, seq bigint",
    "states": "id string, page_id string, route string, auth_kind string, auth_role string, principal string, session string, network_status string, network_evidence string, "
    "viewport struct<w:double,h:double,dpr:double,scroll_x:double,scroll_y:double>, focused_ax_id string, open_dialog_ids array<string>, open_popover_ids array<string>, expanded_region_ax_ids array<string>, conditional_markers map<string,string>, first_observed_at string, seq bigint",
    "state_elements": f"state_id string, ax_id string, rect {RECT}, visibility string, z_index double, open boolean, expanded boolean, selected boolean, checked boolean, pressed boolean, busy boolean, focused boolean, aria_states map<string,string>, visual_node_id string",
    "state_evidence": "state_id string, kind string, source_ax_id string, transition_id string, at string, seq bigint",
    "auth": "id string, kind string, role string, principal string, session string, first_observed_at string, observation_count bigint, seq bigint",
    "tokens": "path string, value string, value_kind string, type string, description string, seq bigint",
    "diagnostics": "kind string, page_id string, url string, source string, message string, at string, seq bigint",
    "meta": "version string, root_url string, started_at string, complete boolean, frontier_hash string, build_version string",
}

#: Node kinds in the order in which a query of ``any`` concatenates them.
ANY_ORDER = ("ax", "visual", "edges", "capabilities", "transitions", "pages", "nav", "states")
#: Names of the kinds in requests.
KINDS = {
    "page": "pages", "ax-node": "ax", "visual-node": "visual", "edge": "edges", "capability": "capabilities",
    "transition": "transitions", "nav-element": "nav", "state": "states",
}


def page_id(canonical_url: str) -> str:
    return f"page:{canonical_url}"


def edge_id(src: str, dst: str, kind: str) -> str:
    return f"edge:{src}->{dst}:{kind}"


def page_of_ax(ax_id: str) -> str | None:
    """The page id inside an ax id: what is before the last colon after the scheme."""
    m = re.match(r"^ax:(.*://.*):[^:]*$", ax_id) or re.match(r"^ax:(.*):[^:]*$", ax_id)
    return m[1] if m else None

from .readers import read_edge_list, read_edges_json, read_node_labels, read_nodes_csv, read_worker_csv
from .writers import write_edges_json, write_pilot_csv, write_result_json, write_worker_csv

__all__ = [
    "read_edge_list",
    "read_edges_json",
    "read_node_labels",
    "read_nodes_csv",
    "read_worker_csv",
    "write_edges_json",
    "write_pilot_csv",
    "write_result_json",
    "write_worker_csv",
]

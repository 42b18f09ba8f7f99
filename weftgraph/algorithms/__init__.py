"""Ready-made algorithms. Those that iterate are vertex programs; those that don't are plain joins."""

from weftgraph.algorithms.cellular import game_of_life, grid_graph, schelling
from weftgraph.algorithms.clustering import clustering_coefficient, components, label_clustering
from weftgraph.algorithms.colouring import colour, conflicts
from weftgraph.algorithms.linear import company_valuation, counting
from weftgraph.algorithms.paths import hamiltonian_paths, path_pattern, shortest_paths
from weftgraph.algorithms.rank import delta_pagerank, pagerank
from weftgraph.algorithms.sudoku import solve_sudoku

__all__ = [
    "clustering_coefficient", "colour", "company_valuation", "components", "conflicts", "counting", "delta_pagerank", "game_of_life", "grid_graph",
    "hamiltonian_paths", "label_clustering", "pagerank", "path_pattern", "schelling", "shortest_paths", "solve_sudoku",
]

"""An analytics engine on Spark for collections of graphs, document fragments and multi-vector embeddings."""

"""trackloom: trajectory analytics and density clustering as Spark plans."""

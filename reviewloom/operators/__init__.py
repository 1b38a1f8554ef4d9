"""DataFrame -> DataFrame operators: windows, DBSCAN, components, centroids, quotes, themes, rendering, report store."""

"""Column layouts of the engine's tables. Nodes are known by label; a table of several trees, thresholds or replicates
has further key columns, which every operator carries."""

NODES = "node_id int, parent_id int, label string, parent string, is_leaf boolean, length double, child_ix int, depth int, species string, is_dup string, nd string"
EVIDENCE = "donor string, receptor string, weight double, family string, support double, distance double, source string, weight_semantics string, sample_denominator long, ingest_seq long"
EDGES = "donor string, receptor string, weight double, first_seq long"
CLOSURE = "anc string, des string, hops long"
POSITIONS = "order_id long, label string, pos long"
CHAIN = "chain_id long, step long, state string, energy double"
VIOLATIONS = "severity string, check string, detail string"

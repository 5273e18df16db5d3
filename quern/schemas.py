"""Record types. JSON is always read with these, never with inferred ones."""

BLOCK = "struct<type:string,text:string,thinking:string,signature:string,url:string,id:string,name:string,input_json:string,tool_use_id:string,content:string,is_error:boolean>"
MESSAGES = f"conv_id long, turn long, role string, text string, blocks array<{BLOCK}>"
SECTIONS = "corpus_id string, ord long, path string, title string, summary string, tags array<string>, tokens long, updated_at string, content string"
QUERIES = "query_id long, corpus_id string, text string, max_tokens long"
EMBEDDING_CACHE = "corpus_id string, ord long, path string, embedding array<double>, content_hash string, updated_at string"
PROPOSALS = "corpus_id string, seq long, id string, agent_id string, section string, operation string, content string, rationale string, ts string, generation long"
MUTATIONS = "corpus_id string, id string, generation long, section string, agent_id string, operation string, rationale string, ts string, diff string"
OUTCOME = "struct<success:boolean,testsPassedBefore:long,testsPassedAfter:long,filesModified:long,duration:double,costUsd:double>"
STRATEGIES = f"corpus_id string, seq long, id string, name string, description string, agent_id string, generation long, category string, outcome {OUTCOME}, ts string"
SESSION_LOG = "seq long, ts string, agent string, event string, cwd string, session string, tool string, path string, summary string, meta string"
LINEAGE = "corpus_id string, generation long, milestone string, started_at string, ended_at string, mutation_count long, fitness_scores map<string,double>"
FITNESS_HISTORY = "corpus_id string, ord long, generation long, scores map<string,double>"
MANIFEST = (
    "version int, project string, sections array<struct<path:string,title:string,summary:string,tags:array<string>,tokens:long,updatedAt:string>>, "
    "generation struct<number:long,milestone:string,startedAt:string,endedAt:string>, fitnessHistory array<struct<generation:long,scores:map<string,double>>>, createdAt string, updatedAt string"
)
